"""Version history: which saved versions are worth keeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

HOUR, DAY, WEEK = 3600, 86400, 604800


def time_bucket(now: Column, saved_at: Column) -> Column:
    """One bucket for the last hour, one an hour for a day, one a day for a week, then one a week."""
    age = F.greatest(now - saved_at, F.lit(0)).cast("bigint")
    return (
        F.when(age < HOUR, F.lit(0)).when(age < DAY, 1 + F.floor(age / HOUR)).when(age < WEEK, 1_000_000 + F.floor(age / DAY)).otherwise(2_000_000 + F.floor(age / WEEK)).cast("bigint")
    )


def ranked(versions: DataFrame) -> DataFrame:
    """versions with rn: 1 for the newest of each file."""
    return versions.withColumn("rn", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("saved_at"), F.desc("id"))))


def newest(versions: DataFrame) -> DataFrame:
    """One row per file, by an aggregate that is combined before the shuffle."""
    best = F.max(F.struct("saved_at", "id", "size", "reason")).alias("v")
    return versions.groupBy("file_id").agg(best).select("file_id", "v.id", "v.saved_at", "v.size", "v.reason")


def all_but(versions: DataFrame, n: int = 3) -> DataFrame:
    """Versions but the n newest of each file. Only those n are ranked, and cut within each task before the shuffle."""
    top = ranked(versions.select("file_id", "id", "saved_at")).where(F.col("rn") <= n).select("file_id", "id")
    return versions.join(top, ["file_id", "id"], "left_anti")


def retention(versions: DataFrame, now: int, keep_versions: int = 10, keep_days: int = 90) -> DataFrame:
    """versions with kept.

    The newest stays; so do, unless older than keep_days, the oldest, states before a restore, and the first of each
    time bucket while fewer than keep_versions are kept. Every kept row takes its bucket and a place, newest first.
    Buckets follow each other in time, and of one only its newest row can stay for the bucket's sake. So rows are
    reduced to buckets by an aggregate, however many a file has, and a fold goes over a file's few buckets.
    """
    old = F.col("saved_at") < now - keep_days * DAY
    undo = F.coalesce(F.col("reason") == "before_restore", F.lit(False))
    rows = versions.select("file_id", "id", "saved_at", time_bucket(F.lit(now), F.col("saved_at")).alias("bucket"), undo.alias("undo"), old.alias("old"))
    buckets = rows.where(~F.col("old")).groupBy("file_id", "bucket").agg(F.max(F.struct("saved_at", "id", "undo")).alias("first"), F.count_if("undo").alias("undone"))
    listed = buckets.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("bucket", "first", "undone"))).alias("buckets"))
    ends = rows.groupBy("file_id").agg(F.max(F.struct("saved_at", "id"))["id"].alias("newest"), F.min(F.struct("saved_at", "id"))["id"].alias("oldest"), F.max("old").alias("any_old"))
    per_file = ends.join(listed, "file_id", "left")
    start = F.struct(F.array().cast("array<bigint>").alias("ids"), F.lit(0).cast("bigint").alias("places"))

    def step(acc: Column, x: Column) -> Column:
        first = x["first"]
        newest = first["id"] == F.col("newest")
        # what stays in any case needs no bucket, but takes places before those that follow
        anyway = first["undo"] | newest | ((first["id"] == F.col("oldest")) & ~F.col("any_old"))
        stays = ~anyway & (acc["places"] < keep_versions)
        taken = x["undone"] + (newest & ~first["undo"]).cast("bigint") + stays.cast("bigint")
        ids = F.when(stays, F.concat(acc["ids"], F.array(first["id"]))).otherwise(acc["ids"])
        return F.struct(ids.alias("ids"), (acc["places"] + taken).alias("places"))

    chosen = F.aggregate(F.coalesce("buckets", F.array().cast(listed.schema["buckets"].dataType)), start, step)["ids"]
    ids = F.concat(chosen, F.array("newest"), F.when(F.col("any_old"), F.array().cast("array<bigint>")).otherwise(F.array("oldest")))
    kept = per_file.select("file_id", F.explode(F.array_distinct(ids)).alias("id")).withColumn("chosen", F.lit(True))
    out = versions.join(kept, ["file_id", "id"], "left")
    return out.withColumn("kept", F.coalesce("chosen", F.lit(False)) | (undo & ~old)).drop("chosen")


def _sizes(versions: DataFrame) -> DataFrame:
    """(file_id, bytes): of each file what all its versions but the newest take, by one aggregate."""
    newest_size = F.max(F.struct("saved_at", "id", "size"))["size"]
    return versions.groupBy("file_id").agg((F.sum("size") - newest_size).alias("bytes"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def cost(versions: DataFrame) -> DataFrame:
    """(bytes): what all versions but each file's newest take."""
    return _sizes(versions).agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"))


def hogs(versions: DataFrame, budget: int) -> DataFrame:
    """(file_id, bytes) of files whose older versions take over a tenth of the budget."""
    return _sizes(versions).where(F.col("bytes") * 10 > budget)


def evict(versions: DataFrame, need: int, buckets: int = 64) -> DataFrame:
    """(id, size) of the oldest versions that together reach need bytes; the one that crosses is in, newest ones are not.

    The running sum is taken over days first: only the day in which the sum crosses is put in order in one place.
    """
    old = versions.join(newest(versions).select("file_id", "id"), ["file_id", "id"], "left_anti").withColumn("day", F.floor(F.col("saved_at") / DAY))
    days = old.groupBy("day").agg(F.sum("size").alias("bytes"))
    # one row a day: a bounded series, whatever the number of versions
    before = days.withColumn("before", F.sum("bytes").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("day", F.coalesce("before", F.lit(0)).alias("before")).where(F.col("before") < need)
    inside = old.join(F.broadcast(before), "day")
    order = Window.partitionBy("day").orderBy("saved_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return inside.withColumn("sum", F.col("before") + F.sum("size").over(order)).where(F.col("sum") - F.col("size") < need).select("id", "size")


def unkept(files: DataFrame, versions: DataFrame) -> DataFrame:
    """Files (file_id, mtime, size) whose state is not their newest version."""
    n = newest(versions).select("file_id", F.col("saved_at").alias("v_at"), F.col("size").alias("v_size"))
    return files.join(n, "file_id", "left").where(F.col("v_at").isNull() | (F.col("v_at") != F.col("mtime")) | (F.col("v_size") != F.col("size"))).drop("v_at", "v_size")


def budget_bytes(gib: int, disk: int) -> int:
    return gib << 30 if gib > 0 else min(disk // 20, 10 << 30)


def budget(gib: Column, disk: Column) -> Column:
    """Bytes that versions may take on disks of a size: what is set, else a twentieth of the disk and 10 GiB at most."""
    return F.when(gib > 0, gib.cast("bigint") * (1 << 30)).otherwise(F.least(F.floor(disk / 20), F.lit(10 << 30))).cast("bigint")


# fixed values: extensions of documents, and marks of names that are none
DOCUMENTS = ("odt", "ods", "odp", "odg", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "rtf", "md", "txt")


def may_be_a_document(name: Column) -> Column:
    """By name alone: a document's extension, no mark of lock, backup or temporary files."""
    low = F.lower(name)
    marks = low.startswith("~$") | low.startswith(".~lock") | low.endswith("~") | low.endswith(".tmp") | low.endswith(".bak")
    return F.regexp_extract(low, r"(?s)^.+\.([^.]+)$", 1).isin(*DOCUMENTS) & ~marks


def eligible(files: DataFrame, largest: int = 128 << 20) -> DataFrame:
    """Files of a document's type, not empty and of at most 128 MiB, that are no lock, backup or temporary files."""
    return files.where(may_be_a_document(F.col("name")) & (F.col("size") > 0) & (F.col("size") <= largest))


def earlier(versions: DataFrame, live: DataFrame) -> DataFrame:
    """versions(file_id, id, saved_at, mtime_s, mtime_ns, size, ...) but those equal to their file's live state.

    live(file_id, mtime_s, mtime_ns, size); a file that isn't there has all its versions listed. Lists are ordered by
    (saved_at, id), newest first.
    """
    now = live.select("file_id", F.struct("mtime_s", "mtime_ns", "size").alias("live"))
    out = versions.join(now, "file_id", "left")
    return out.where(F.col("live").isNull() | (F.col("live") != F.struct("mtime_s", "mtime_ns", "size"))).drop("live")


def kept_already(files: DataFrame, versions: DataFrame) -> DataFrame:
    """(file_id) of files(file_id, mtime_s, mtime_ns, size) whose newest version is their state, to the nanosecond."""
    last = versions.groupBy("file_id").agg(F.max_by(F.struct("mtime_s", "mtime_ns", "size"), F.struct("saved_at", "id")).alias("last"))
    return files.join(last, "file_id").where(F.col("last") == F.struct("mtime_s", "mtime_ns", "size")).select("file_id")


def mark_undo(versions: DataFrame, files: DataFrame) -> DataFrame:
    """versions with before_restore as the reason of the newest of each of files(file_id)."""
    last = versions.join(files.select("file_id").distinct(), "file_id", "left_semi").groupBy("file_id").agg(F.max_by("id", F.struct("saved_at", "id")).alias("undo"))
    out = versions.join(last, "file_id", "left")
    return out.withColumn("reason", F.when(F.col("id") == F.col("undo"), "before_restore").otherwise(F.col("reason"))).drop("undo")


def place(seen: DataFrame, files: DataFrame, present: DataFrame) -> DataFrame:
    """seen(path, dev, ino, born) with the id of its row in files(id, path, dev, ino, born, created_at), null if it is new.

    The path decides, as a save may replace what lies there. Else it is the newest row of the same dev and ino, and of
    the same birth where both are known, if nothing lies at that row's path in present(path) any more.
    """
    by_path = files.select("path", F.col("id").alias("by_path"))
    gone = files.join(present.select("path"), "path", "left_anti")
    gone = gone.select("dev", "ino", F.col("born").alias("was_born"), "created_at", F.col("id").alias("moved"))
    out = seen.join(by_path, "path", "left")
    moved = out.where("by_path is null").join(gone, ["dev", "ino"]).where("born is null or was_born is null or born = was_born")
    moved = moved.groupBy("path").agg(F.max_by("moved", F.struct("created_at", "moved")).alias("by_identity"))
    return out.join(moved, "path", "left").withColumn("id", F.coalesce("by_path", "by_identity")).drop("by_path", "by_identity")


def follow_renames(files: DataFrame, versions: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, versions) after renames(from, to), each name once: rows move, versions of what was overwritten join them.

    Only renames to a name that may be a document's count; files that have no row are left alone.
    """
    good = renames.where(may_be_a_document(F.substring_index("to", "/", -1)))
    moved = good.join(files.select(F.col("path").alias("from"), F.col("id").alias("from_id")), "from")
    hit = moved.join(files.select(F.col("path").alias("to"), F.col("id").alias("to_id")), "to").where("from_id <> to_id")
    rest = files.join(hit.select(F.col("to_id").alias("id")), "id", "left_anti")
    new = rest.join(moved.select(F.col("from_id").alias("id"), "to"), "id", "left")
    new = new.withColumn("missing_since", F.when(F.col("to").isNull(), F.col("missing_since"))).withColumn("path", F.coalesce("to", "path")).drop("to")
    joined = versions.join(hit.select(F.col("to_id").alias("file_id"), "from_id"), "file_id", "left")
    return new.select(*files.columns), joined.withColumn("file_id", F.coalesce("from_id", "file_id")).select(*versions.columns)


def presence(files: DataFrame, present: DataFrame, now: int, grace: int = 7 * DAY) -> DataFrame:
    """files(id, path, missing_since) with state and missing_since after a look at what is there.

    back: was missing and isn't; missing: gone since now; expired: gone for longer than the grace, to be forgotten;
    else same.
    """
    here = present.select("path", F.lit(True).alias("here"))
    out = files.join(here, "path", "left")
    there, since = F.coalesce("here", F.lit(False)), F.col("missing_since")
    state = F.when(there & since.isNotNull(), "back").when(~there & since.isNull(), "missing").when(~there & (F.lit(now) - since > grace), "expired").otherwise("same")
    out = out.withColumn("state", state)
    return out.withColumn("missing_since", F.when(F.col("state") == "missing", F.lit(now)).when(F.col("state") != "back", since).cast("bigint")).drop("here")


def forget(files: DataFrame, versions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, versions) without those of gone(id)."""
    ids = gone.select("id").distinct()
    return files.join(ids, "id", "left_anti"), versions.join(ids.withColumnRenamed("id", "file_id"), "file_id", "left_anti")


def orphans(versions: DataFrame, objects: DataFrame) -> DataFrame:
    """(object, what): versions without an object (row) and objects(object) that no version claims (object)."""
    v, o = versions.select("object").distinct(), objects.select("object").distinct()
    return v.join(o, "object", "left_anti").withColumn("what", F.lit("row")).union(o.join(v, "object", "left_anti").withColumn("what", F.lit("object")))


# fixed values: free bytes under which no versions are kept, and how many times the store's cost must be free
LOW_DISK, FREE_TO_STORE = 2 << 30, 10


def low_disk(cost: Column) -> tuple[Column, Column]:
    """(free bytes under which no versions are kept, free bytes that are climbed back to)."""
    threshold = F.greatest(F.lit(LOW_DISK).cast("bigint"), cost.cast("bigint") * FREE_TO_STORE)
    return threshold, threshold + F.floor(threshold / 4)


def give_back(versions: DataFrame, free: int) -> DataFrame:
    """(id, size) of the oldest versions to drop so that the disk recovers: none while it isn't low."""
    n = cost(versions).first()["bytes"]
    threshold = max(LOW_DISK, n * FREE_TO_STORE)
    need = threshold + threshold // 4 - free if free < threshold else 0
    return evict(versions, need)


def left_to_git(files: DataFrame, trees: DataFrame, ignored: DataFrame, skip_repositories: bool = True, respect_gitignore: bool = True) -> DataFrame:
    """(path) of files in work trees trees(root) that git looks after: all of them, or only those of ignored(path)."""
    up = files.select("path", F.explode(paths.ancestors(F.col("path"))).alias("root"))
    inside = up.join(trees.select("root"), "root", "left_semi").select("path").distinct()
    if skip_repositories:
        return inside
    return inside.join(ignored.select("path"), "path", "left_semi") if respect_gitignore else inside.limit(0)


def to_save(files: DataFrame, versions: DataFrame, git: DataFrame, paused: bool = False) -> DataFrame:
    """(file_id, path, reason) of files(file_id, path, name, ext, size, mtime_s, mtime_ns) that earn a version now.

    Documents that git (path) doesn't look after and whose state isn't kept. The first version of a file is its
    baseline, which costs nothing and is taken even while space is short; others are saves.
    """
    good = eligible(files).join(git.select("path"), "path", "left_anti").join(kept_already(files, versions), "file_id", "left_anti")
    known = versions.select("file_id").distinct().withColumn("known", F.lit(True))
    out = good.join(known, "file_id", "left").withColumn("reason", F.when(F.col("known"), "saved").otherwise("baseline"))
    out = out.where("reason = 'baseline'") if paused else out
    return out.select("file_id", "path", "reason")
