"""URL filters: a cascade of Bloom filters gives exact membership of a rule list without a join.

Level 0 encodes the listed keys. Level 1 encodes the keys of the corpus that level 0 takes wrongly for
listed ones, level 2 the listed keys that level 1 takes wrongly for those, and so on until a level makes no
mistake over the corpus's complete key universe. A probe walks down until a level says no; whether that
level is odd or even is the exact answer for every key of the universe.

Everything on the data path is a built-in function: the bits are literals of the plan, and a key is probed by
xxhash64, substring and getbit inside the scan's code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, stage

#: A filter over this many bytes isn't put into a plan; the keys are joined instead.
MAX_FILTER_BYTES = 8 << 20
#: Levels of a cascade; each has a fraction of the mistakes of the one before, so more would be no accident
MAX_LEVELS = 64


@dataclass(frozen=True)
class Bloom:
    bits: bytes
    hashes: int
    seed: int

    def probe(self, key: Column) -> Column:
        m = len(self.bits) * 8
        data = F.lit(bytearray(self.bits))
        found = None
        for at in _positions(key, self.hashes, self.seed, m):
            byte = F.conv(F.hex(F.substring(data, (at.cast("bigint") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
            bit = F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1
            found = bit if found is None else found & bit
        return found


def _positions(key: Column, hashes: int, seed: int, m: int) -> list[Column]:
    a = F.xxhash64(key, F.lit(seed))
    b = F.xxhash64(key, F.lit(seed + 1_000_003))
    half = lambda c, n: F.shiftrightunsigned(c, n).cast("bigint")
    return [F.pmod(half(a, 2) + half(b, 6) * F.lit(i), F.lit(m)) for i in range(hashes)]


def bloom(keys: DataFrame, n: int, fpr: float, seed: int, limit: int) -> Bloom | None:
    """Over n keys of the column key; None when it would be larger than limit bytes.

    The bits are gathered by byte, so what reaches the driver is never more than the filter itself.
    """
    fpr = min(max(fpr, 1e-12), 0.5)
    size = max(8, math.ceil(n * math.log2(1 / fpr) / math.log(2) / 8))
    if size > limit:
        return None
    hashes = max(1, min(16, round(size * 8 / max(n, 1) * math.log(2))))
    at = F.explode(F.array(*_positions(F.col("key"), hashes, seed, size * 8)))
    found = (
        keys.select(at.alias("at"))
        .groupBy((F.col("at") / 8).cast("int").alias("byte"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.pmod("at", F.lit(8)).cast("int"))).alias("bits"))
        .collect()
    )
    data = bytearray(size)
    for r in found:
        data[r["byte"]] = r["bits"]
    return Bloom(bytes(data), hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Bloom, ...]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built over."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for k in reversed(range(len(self.levels))):
            answer = F.when(self.levels[k].probe(key), answer).otherwise(F.lit(k % 2 == 1))
        return F.coalesce(answer, F.lit(False))

    @property
    def size(self) -> int:
        return sum(len(x.bits) for x in self.levels)


def build_cascade(listed: DataFrame, universe: DataFrame, n_universe: int, limit: int = MAX_FILTER_BYTES) -> Cascade | None:
    """Over column key of both. listed: distinct keys; universe: all keys, repeats allowed.

    Only keys that level 0 passes are shuffled, and they are counted once for each task before that.
    None: a level would outgrow the limit, or mistakes are left after MAX_LEVELS; the caller has to join then.
    """
    n = listed.count()
    if not n:
        return Cascade(())
    first = bloom(listed, n, 0.7 * n / max(n_universe, n), 11, limit)
    if first is None:
        return None
    flagged = universe.where(F.col("key").isNotNull() & first.probe(F.col("key"))).select("key", F.lit(0).alias("on"))
    flagged = flagged.union(listed.select("key", F.lit(1).alias("on"))).groupBy("key").agg(F.max("on").alias("on"))
    held = stage(flagged, "cascade")
    levels = [first]
    sets = {0: held.where("on = 1").select("key"), 1: held.where("on = 0").select("key")}
    while n_next := sets[len(levels) % 2].count():
        if len(levels) == MAX_LEVELS:
            return None
        wrong = len(levels) % 2
        level = bloom(sets[wrong], n_next, 0.25, 11 + 2 * len(levels), limit)
        if level is None:
            return None
        levels.append(level)
        sets[1 - wrong] = sets[1 - wrong].where(level.probe(F.col("key")))
    drop_staged(held)
    return Cascade(tuple(levels))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or end, A-Z in lower case. Path: then up to ? # or end."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> list[Column]:
    """For each shape (labels of the host, characters of the path) of a rule: what a rule of it would read, else null."""
    labels = F.when(host == "", F.lit(0)).otherwise(F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1)
    return [
        F.when((labels >= n) & (F.char_length(path) >= p), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, p)))
        for n, p in shapes
    ]


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    url: str = "url",
    default: str = "allow",
    limit: int = MAX_FILTER_BYTES,
) -> DataFrame:
    """Add host, path, rule and verdict to pages. rules: (verdict, host, path), verdict block or allow.

    A rule fits its host and all subdomains if the path starts with its path; of several the longest (host and
    path together, then the longer host) wins. The probed keys of a URL are one for each distinct shape in the list.
    Null URLs and URLs without :// have an empty host and path, fit no rule and get the default. No rules: all get it.
    A host or path listed twice takes its first verdict. A pages column named host, path, rule or verdict is replaced.
    """
    spark: SparkSession = pages.sparkSession
    wanted: dict[str, str] = {}
    for verdict, host, path in rules:
        wanted.setdefault(host.lower() + path, verdict)
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    host, path = host_and_path(F.col(url))
    base = pages.withColumns({"host": host, "path": path})
    if not wanted:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    table = spark.createDataFrame([(k, v) for k, v in wanted.items()], "key string, listed_verdict string")
    keys = candidate_keys(F.col("host"), F.col("path"), shapes)
    listed = table.select("key")
    universe = base.select(F.explode(F.array(*keys)).alias("key")).where("key is not null")
    cascade = build_cascade(listed, universe, universe.count(), limit)
    blocked = build_cascade(table.where("listed_verdict = 'block'").select("key"), listed, len(wanted), limit)
    if cascade is None or blocked is None:
        return _joined(base, keys, table, default)
    hits = [F.when(cascade.contains(k), F.struct(F.char_length(k).alias("n"), F.char_length(F.substring_index(k, "/", 1)).alias("h"), k.alias("key"))) for k in keys]
    best = (F.greatest(*hits) if len(hits) > 1 else hits[0])["key"]
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(blocked.contains(F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    return base.withColumn("rule", best).withColumn("verdict", verdict)


def _joined(base: DataFrame, keys: list[Column], table: DataFrame, default: str) -> DataFrame:
    """For lists whose filters are too large for a plan: a join on the distinct candidate keys."""
    order = F.struct(F.char_length("key").alias("n"), F.char_length(F.substring_index("key", "/", 1)).alias("h"), "key", "listed_verdict")
    hosts = base.select("host", "path").distinct().withColumn("key", F.explode(F.array_distinct(F.array(*keys))))
    best = hosts.where("key is not null").join(table, "key").groupBy("host", "path").agg(F.max(order).alias("best"))
    out = base.join(best, ["host", "path"], "left")
    return out.withColumns({"rule": F.col("best.key"), "verdict": F.coalesce("best.listed_verdict", F.lit(default))}).drop("best")
