"""Streams of file events: bursts, debounce, and the state that they keep up to date."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import catalogue, history, origin
from ..sources import shared


def with_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a zoned timestamp."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def sessions(events: DataFrame, key: str = "user_id", gap: str = "3 seconds", late: str | None = None) -> DataFrame:
    """(key, start, end, n): bursts of a key's events that lie at most gap apart. late: watermark, for streams."""
    timed = with_time(events)
    if late is not None:
        timed = timed.withWatermark("ts", late)
    out = timed.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def coalesce_bursts(events: DataFrame, width: str = "250 milliseconds", key: str = "path") -> DataFrame:
    """Distinct keys of each burst: (start, key)."""
    return with_time(events).select(F.window("ts", width)["start"].alias("start"), key).distinct()


def name_doc_stale(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths of new whose name document has to be written: unknown ones, and those whose day changed."""
    o = old.select("path", F.col("mtime").alias("m"))
    n = new.join(o, "path", "left")
    return n.where(F.col("m").isNull() | (paths.mtime_day(F.col("m")) != paths.mtime_day(F.col("mtime")))).select("path")


def events_of(batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, roots, moves) of a batch of events (ts, kind, path, path_to, mtime, size): each path by its last event.

    sets(path, mtime, size) are files that are there; roots(root) went, with all below; moves(root, to) are renames
    with both names, each of which takes its tree along.
    """
    last = batch.groupBy("path").agg(F.max_by(F.struct("kind", "path_to", "mtime", "size"), "ts").alias("e")).select("path", "e.*")
    sets = last.where("kind in ('create', 'modify', 'close')").select("path", "mtime", "size")
    moved = last.where("kind = 'rename' and path_to is not null")
    sets = sets.unionByName(moved.where("mtime is not null").select(F.col("path_to").alias("path"), "mtime", "size")).groupBy("path").agg(F.max("mtime").alias("mtime"), F.max_by("size", "mtime").alias("size"))
    roots = last.where("kind = 'remove' or (kind = 'rename' and path_to is null)").select(F.col("path").alias("root"))
    # of several things renamed to one name the last in order of their paths is there
    moves = moved.groupBy("path_to").agg(F.max("path").alias("root")).select("root", F.col("path_to").alias("to"))
    return sets, roots, moves


def judged(sets: DataFrame, state: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets, roots): what changes of sets(path, mtime, size), and what leaves because it is excluded(path) now.

    A path that is recorded as it is changes nothing. An excluded path that is recorded leaves with its tree, one that
    isn't is passed over.
    """
    known = state.select("path", F.struct("mtime", "size").alias("known"))
    out = sets.join(excluded.select("path", F.lit(True).alias("out")), "path", "left").join(known, "path", "left")
    changed = out.where("out is null and (known is null or known <> struct(mtime, size))").select("path", "mtime", "size")
    return changed, out.where("out and known is not null").select(F.col("path").alias("root"))


def origin_paths(events: DataFrame, limit: int = 256) -> DataFrame:
    """(path) whose origin is worth a look; none at all if a batch has more than limit of them."""
    found = origin.of_event(events)
    few = found.limit(limit + 1).agg((F.count(F.lit(1)) <= limit).alias("few"))
    return found.crossJoin(F.broadcast(few)).where("few").select("path")


def history_paths(events: DataFrame, limit: int = 512) -> DataFrame:
    """(path) of documents that may have just been saved, the first limit by path: closed after writing, created, renamed to."""
    kinds = events.where("kind in ('close', 'create', 'rename')")
    saved = kinds.select(F.when(F.col("kind") == "rename", F.coalesce("path_to", "path")).otherwise(F.col("path")).alias("path")).distinct()
    return saved.where(history.may_be_a_document(F.substring_index("path", "/", -1))).orderBy("path").limit(limit)


def catch_up(state: DataFrame, folders: DataFrame, entries: DataFrame, walk_started: int) -> DataFrame:
    """(path) to compare again after a walk: what lies directly in folders that changed since it began.

    folders(path, mtime) as they are now, entries(path) on disk. A second is allowed for.
    """
    changed = folders.where(F.col("mtime") >= walk_started - 1).select(F.col("path").alias("folder"))
    both = state.select("path").union(entries.select("path")).distinct()
    return both.withColumn("folder", paths.parent(F.col("path"))).join(changed, "folder", "left_semi").select("path")


def due(changes: DataFrame, now: int, wait: int = 3, limit: int = 4096) -> DataFrame:
    """(path, deadline) that are due by now of changes(path, at), the earliest first: each change puts a path off by wait.

    At most limit paths wait, those that came first; changes of others are dropped.
    """
    waiting = changes.groupBy("path").agg(F.min("at").alias("first"), (F.max("at") + wait).alias("deadline"))
    held = waiting.orderBy("first", "path").limit(limit)
    return held.where(F.col("deadline") <= now).select("path", "deadline").orderBy("deadline", "path")


class Reconciler:
    """foreachBatch target for events (ts, kind, path, path_to, mtime, size) that keeps a catalogue table.

    Each batch writes a new state folder and then a marker that names it, so a crash between the two repeats the batch;
    states before the last are deleted then. Removals take whole trees, renames move them; what a batch sets
    afterwards survives them. An event of kind overflow says that others were lost: the tree has to be compared with
    the state as a whole, by rescan(). observe(origin paths, history paths) is told what else a batch is about.
    """

    def __init__(self, folder: str, origin_limit: int = 256, history_limit: int = 512, observe=None) -> None:
        self.folder, self.origin_limit, self.history_limit, self.observe = folder.rstrip("/"), origin_limit, history_limit, observe

    def _last(self, spark) -> int | None:
        marks = [n for n in shared.names(spark, f"{self.folder}/marks") if n.lstrip("-").isdigit()]
        return max(map(int, marks), default=None)

    def state(self, spark) -> DataFrame | None:
        last = self._last(spark)
        return None if last is None else spark.read.parquet(f"{self.folder}/state/batch={last}").select("path", "mtime", "size")

    def overflowed(self, spark) -> bool:
        """Whether events were lost since the tree was last compared as a whole."""
        last = self._last(spark)
        return last is not None and spark.read.parquet(f"{self.folder}/marks/{last}").first()["overflow"]

    def _write(self, new: DataFrame, number: int, overflow: bool) -> None:
        spark = new.sparkSession
        before = self._last(spark)
        new.select("path", "mtime", "size").write.mode("overwrite").parquet(f"{self.folder}/state/batch={number}")
        spark.range(1).select(F.lit(overflow).alias("overflow")).write.mode("overwrite").parquet(f"{self.folder}/marks/{number}")
        for old in shared.names(spark, f"{self.folder}/state"):
            n = int(old.removeprefix("batch="))
            # the one before is left to readers that have begun
            if n < number and n != before:
                shared.remove(spark, f"{self.folder}/state/{old}")
                shared.remove(spark, f"{self.folder}/marks/{n}")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = self._last(spark)
        if last is not None and number <= last:
            return  # the batch is repeated, its state is there
        sets, roots, moves = events_of(batch.where("kind <> 'overflow'"))
        state = self.state(spark)
        state = sets.limit(0) if state is None else state
        lost = self.overflowed(spark) or not batch.where("kind = 'overflow'").isEmpty()
        self._write(catalogue.apply_changes(catalogue.move_trees(state, moves), sets, roots), number, lost)
        if self.observe is not None:
            self.observe(origin_paths(batch, self.origin_limit), history_paths(batch, self.history_limit))

    def rescan(self, seen: DataFrame, offline: DataFrame) -> DataFrame:
        """Compare the whole tree seen(path, mtime, size) with the state and take it over; (path, change) of what differs.

        Trees of sources that are away, offline(prefix), stay as they are. So a service begins, and so it goes on after
        events were lost.
        """
        spark = seen.sparkSession
        state = self.state(spark)
        state = seen.limit(0).select("path", "mtime", "size") if state is None else state
        whole = catalogue.retain_prefixes(state, seen.select("path", "mtime", "size"), offline)
        changes = catalogue.scan_changes(whole, state).where("change <> 'unchanged'")
        path = f"{self.folder}/changes"
        changes.write.mode("overwrite").parquet(path)
        last = self._last(spark)
        # a rescan has the number of the batch that it follows, as the stream's next one is higher; it reads that state,
        # so what it writes is written beside it first
        half = shared.scratch(spark, "rescan")
        whole.write.parquet(half)
        self._write(spark.read.parquet(half), -1 if last is None else last, False)
        shared.remove(spark, half)
        return spark.read.parquet(path)


def run(stream: DataFrame, folder: str, state_dir: str, paused: bool = False, **limits) -> Reconciler:
    """Follow a stream of events until it has no more; start it again to go on. paused: do nothing, and lose nothing.

    How much a batch takes is up to the stream's own options (maxFilesPerTrigger).
    """
    target = Reconciler(folder, **limits)
    if not paused:
        stream.writeStream.foreachBatch(target).option("checkpointLocation", state_dir).trigger(availableNow=True).start().awaitTermination()
    return target


@dataclass(frozen=True)
class Backfill:
    """What the reading of contents has still to do; each event gives the next state. Times are seconds.

    pending: a pass is wanted or under way. cursor: the path after which it goes on. again: a change came meanwhile, so
    another pass follows. hurry: files that were just edited are read too. until: no batch before then. failures: that
    failed in a row.
    """

    idle: int = 5
    longest: int = 600
    pending: bool = False
    cursor: str | None = None
    again: bool = False
    hurry: bool = False
    until: int | None = None
    failures: int = 0

    def request(self) -> Backfill:
        return replace(self, pending=True, again=self.again or self.pending, until=None)

    def search(self, now: int) -> Backfill:
        """A search of contents wants what is pending: a pass that doesn't wait for edits, soon; more searches don't put it off."""
        at = now + self.idle if self.until is None or not self.hurry else self.until
        return replace(self.request(), hurry=True, until=at)

    def failed(self, now: int) -> Backfill:
        n = self.failures + 1
        return replace(self.request(), failures=n, until=now + min(self.longest, self.idle << min(n, 10)))

    def went_on(self, cursor: str) -> Backfill:
        return replace(self, cursor=cursor, failures=0)

    def ended(self, now: int, retry_in: int | None = None) -> Backfill:
        """The pass is through. retry_in: files within their cooldown are left, the first of which is due then."""
        done = replace(self, cursor=None, hurry=False, failures=0, again=False)
        if self.again:
            return done
        if retry_in is not None:
            return replace(done, until=now + max(retry_in, self.idle))
        return replace(done, pending=False, until=None)

    def wait(self, now: int) -> int:
        return self.idle if self.until is None else max(self.until - now, 0)

    def runs(self, paused: bool) -> bool:
        return self.pending and not paused
