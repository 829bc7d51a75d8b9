"""Texts whose sets of word shingles have a Jaccard similarity of 0.8 or more, by prefix filtering; all such links count.

Put the shingles of all texts into one order, whichever it is. Two sets of n and m members with a similarity of 0.8
share one of the first n - ceil(0.8 n) + 1 members of the one and of the first m - ceil(0.8 m) + 1 of the other. So sets
that share no key of these prefixes aren't similar. The order is that of the hashes, but shingles that many texts hold
come last, the most common at the very end; which those are decides on cost alone, never on what is found.

A group of near copies shares its keys among all its members. Rows that share a key are first held against one of them,
the one most of whose keys others have too: what all copies were made from has no shingles of its own. That makes most
groups one component, and only rows of different components are compared after that. Of rows that share a key with few
others the pairs are joined; crowded keys are compared within tasks, in blocks of bounded size, by parities: for each of
some times as many cells as a set has members, whether an odd number of its hashes falls into it. Two sets' parities never differ
in more cells than the members that one set alone has, so a pair that they rule out is none. The whole texts settle the
rest.

Shingles are compared by 64-bit hashes: two that collide would count as one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, checkpoint, chunked, drop_staged, each, expand, lean, pack_batch, stage, text_bytes
from .components import components
from .simhash import word_hashes

#: Common shingles that are put last, at most
COMMON = 1 << 19
#: Rounds in which the rows of a key are held against one of them, other ones in each; the first settles most groups
STARS = 1
#: Rows of a key whose pairs are joined, at most, and rows of a crowded key that a task compares with as many
FEW, BLOCK = 16, 2048


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted; none without words."""
    return np.unique(word_hashes(text, width))


def similar(overlap: int, n: int, m: int) -> bool:
    """Whether sets of n and m members that share overlap have a Jaccard similarity of 0.8 or more."""
    return overlap > 0 and 9 * overlap >= 4 * (n + m)


def common_shingles(docs: DataFrame, width: int, chunk: int = 8 << 20) -> np.ndarray:
    """Hashes of the common shingles of all texts, the rarest first.

    Each task counts the texts of a chunk that hold a shingle and reports those that two or more hold. What many
    texts of the corpus hold meets in some chunk: of m texts dealt over c chunks, two meet once m is some roots of c.
    """

    def run(batches):
        for table in chunked(batches, "text", chunk):
            keys = np.concatenate([shingle_set(t, width) for t in each(table.column("text"))])
            keys.sort()
            again = keys[1:][keys[1:] == keys[:-1]]
            keys, n = np.unique(again, return_counts=True)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64) + 1)], names=["key", "n"])

    met = docs.select("text").mapInArrow(lean(run), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where("n > 2")
    found = met.orderBy(F.desc("n"), "key").limit(COMMON).select("key").toPandas()["key"].to_numpy(np.int64)
    return found[::-1].copy().view(np.uint64)


def prefixes(docs: DataFrame, width: int, common: np.ndarray, buckets: int, chunk: int = 8 << 20) -> DataFrame:
    """(bucket, blob): the first shingles of each text as rows (key, id, n, at), packed by ranges of key.

    n is the size of the text's set and at the shingle's place in the order; a blob holds differences of sorted keys.
    """
    sorted_at = np.argsort(common)
    known = common[sorted_at]

    def first(text: str | None) -> tuple[np.ndarray, int]:
        h = shingle_set(text, width)
        size = len(h) - (4 * len(h) + 4) // 5 + 1 if len(h) else 0
        if len(h) and len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            last = np.where(known[at] == h, sorted_at[at] + 1, 0)
            h = h[np.argsort(last, kind="stable")]
        return h[:size].copy(), len(h)

    def run(batches):
        for table in chunked(batches, "text", chunk):
            got = [first(t) for t in each(table.column("text"))]
            sizes = [len(h) for h, _ in got]
            if not sum(sizes):
                continue
            keys = np.concatenate([h for h, _ in got])
            ids = np.repeat(table.column("id").to_numpy(), sizes)
            n = np.repeat(np.array([n for _, n in got], np.int32), sizes)
            at = np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])
            order = np.argsort(keys, kind="stable")
            keys, ids, n, at = keys[order], ids[order], n[order], at[order]
            bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            blobs = []
            for s, e in zip(starts, [*starts[1:], len(keys)]):
                columns = [np.diff(keys[s:e], prepend=np.uint64(0)), ids[s:e], n[s:e], at[s:e]]
                blobs.append(pack_batch(pa.record_batch([pa.array(c) for c in columns], names=["key", "id", "n", "at"])))
            yield pa.record_batch([pa.array(bucket[starts]), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return docs.select("id", "text").mapInArrow(lean(run), "bucket int, blob binary")


def shared_keys(packed: DataFrame) -> DataFrame:
    """(key, id, n, at) of the prefix rows whose key others have too."""

    def run(table: pa.Table) -> pa.Table:
        got = [pa.ipc.open_stream(expand(b)).read_all() for b in table.column("blob").to_pylist()]
        key = np.concatenate([np.cumsum(t.column("key").to_numpy(), dtype=np.uint64) for t in got])
        rows = {c: np.concatenate([t.column(c).to_numpy() for t in got]) for c in ("id", "n", "at")}
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        times = np.diff(np.r_[starts, len(key)])
        keep = np.repeat(times > 1, times)
        return pa.table({"key": key[keep].view(np.int64)} | {c: x[order][keep] for c, x in rows.items()})

    return packed.groupBy("bucket").applyInArrow(run, "key bigint, id bigint, n int, at int")


def _possible(n, at, m, at2):
    """Whether sets that first meet at these places can be similar enough."""
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * F.least(n - at, m - at2) >= 4 * (n + m))


def prefix_size(n):
    """Of a set of n members: those that are indexed."""
    return n - F.floor((4 * n + 4) / 5).cast("int") + 1


def parities(h: np.ndarray) -> bytes:
    """For each cell whether an odd number of the hashes falls into it; four to eight cells for a member, as a power of two."""
    cells = 64
    while cells < 4 * len(h):
        cells *= 2
    odd = np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Members that only one of two sets has, at least, by their parities. The larger is folded to the smaller's cells."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def sketched(docs: DataFrame, ids: DataFrame, width: int, keep_text: bool) -> DataFrame:
    """(id, n, bits[, text]) of the docs in ids (id): the size of the set and its parities."""

    def run(batches):
        for batch in batches:
            n, bits = [], []
            for h in (shingle_set(t, width) for t in each(batch.column(1))):
                n.append(len(h))
                bits.append(parities(h))
            new = [pa.array(n, pa.int32()), pa.array(bits, pa.binary())]
            yield pa.record_batch([batch.column(0), *new, *[batch.column(1)] * keep_text], names=["id", "n", "bits", "text"][: 3 + keep_text])

    some = docs.join(ids.select("id").distinct(), "id", "left_semi").select("id", "text")
    return stage(some.mapInArrow(lean(run), "id bigint, n int, bits binary" + ", text string" * keep_text), "sketched")


def verified(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """Those of pairs (a, b) whose whole texts are similar. Only pairs that their parities allow meet their texts."""
    texts = sketched(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), width, True)

    def likely(batches):
        for batch in batches:
            n, m, x, y = (batch.column(k).to_pylist() for k in (2, 4, 3, 5))
            keep = [9 * least_difference(s, t) <= i + j for i, j, s, t in zip(n, m, x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def settle(batches):
        sets = functools.lru_cache(maxsize=64)(lambda text: shingle_set(text, width))
        for batch in batches:
            keep = []
            for s, t in zip(each(batch.column(2)), each(batch.column(3))):
                x, y = sets(s), sets(t)
                keep.append(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def with_both(pairs, *columns):
        for end in ("b", "a"):
            pairs = pairs.join(texts.select(F.col("id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)), end)
        return pairs.select("a", "b", *(f"{c}_{end}" for end in ("a", "b") for c in columns))

    left = stage(with_both(pairs, "n", "bits").mapInArrow(lean(likely), "a bigint, b bigint"), "likely")
    out = stage(with_both(left, "text").mapInArrow(lean(settle), "a bigint, b bigint"), "near-links")
    drop_staged(texts)
    drop_staged(left)
    return out


def allowed_pairs(rows: pa.Table, other: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids of rows, ids of other) of those pairs of different roots that sizes and parities allow, in pieces.

    rows, other: (id, n, root, bits).
    """

    def arrays(t: pa.Table, cells: int, folded: bool):
        """Of the sets with so many cells, or with twice as many, folded: (id, n, root, words of the parities)."""
        size = cells // 8 * (1 + folded)
        at = np.flatnonzero([len(b) == size for b in t.column("bits").to_pylist()])
        some = t.take(pa.array(at))
        words = np.frombuffer(b"".join(some.column("bits").to_pylist()), np.uint64).reshape(len(at), size // 8)
        if folded:
            words = words[:, : size // 16] ^ words[:, size // 16 :]
        return (*(some.column(c).to_numpy() for c in ("id", "n", "root")), words)

    lengths = sorted({len(b) * 8 for t in (rows, other) for b in t.column("bits").to_pylist()})
    for cells in lengths:
        # sizes that differ by less than a fourth have as many cells, or one has twice as many
        for fold, other_fold in ((False, False), (True, False), (False, True)):
            (i, n, r, x), (j, m, q, y) = arrays(rows, cells, fold), arrays(other, cells, other_fold)
            for k in range(0, len(i) if len(j) else 0, 128):
                s = slice(k, k + 128)
                differ = np.zeros((len(i[s]), len(j)), np.int64)
                for w in range(x.shape[1]):
                    differ += np.bitwise_count(x[s, None, w] ^ y[None, :, w])
                total = n[s, None].astype(np.int64) + m[None, :]
                near = (9 * differ <= total) & (9 * np.minimum(n[s, None], m[None, :]) >= 4 * total) & (r[s, None] != q[None, :])
                a, b = np.nonzero(near)
                yield i[s][a], j[b]


def crowded_pairs(docs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(a, b) of rows (key, id, root, crowd) that share a key, have different roots and may be similar by parities.

    crowd: rows of the key. They are dealt to blocks by id; a task compares two blocks of a key, so what it holds is
    bounded, and gives only what the parities allow.
    """
    bits = sketched(docs, rows, width, False)
    blocks = F.ceil(F.col("crowd") / BLOCK).cast("int")
    dealt = rows.join(bits, "id").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    one = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    dealt = dealt.select("key", "id", "n", "root", "bits", "block", F.inline(one))

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = (table.filter(pc.equal(table.column("block"), k)) for k in (i, j))
        found = [(np.minimum(a, b), np.maximum(a, b)) for a, b in allowed_pairs(left, right)]
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
        pairs = np.unique(np.stack([a, b], axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint")


def _named(pairs: DataFrame) -> DataFrame:
    return components(pairs).withColumnRenamed("node", "id")


def _rooted(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    return stage(rows.join(_named(pairs), "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")


def near_components(docs: DataFrame, width: int = 5) -> DataFrame:
    """(id, root) for the rows of docs that are linked to another row, by near_links(); root is the smallest id reachable."""
    return _named(near_links(docs, width))


def near_links(docs: DataFrame, width: int = 5) -> DataFrame:
    """(a, b) of similar rows of docs (id bigint, unique and not null; text), enough of them to reach all from each other.

    Rows are linked if their shingle sets are similar; a link between rows that others join already may be left out.
    Rows without words have no links; texts of fewer than width words have one shingle. An empty table gives no rows.
    """
    buckets = bucket_count(docs.sparkSession, text_bytes(docs), 16 << 20)
    shared = stage(shared_keys(prefixes(docs, width, common_shingles(docs, width), buckets)), "shared")
    # the share of a text's prefix that others have too: highest for what a group was made from
    met = shared.groupBy("id").agg((F.count(F.lit(1)) / prefix_size(F.first("n"))).alias("met"))
    rooted = stage(shared.join(met, "id").withColumn("root", F.col("id")), "rooted")
    drop_staged(shared)
    found = None
    for k in range(STARS):
        first = F.col("met") if k == 0 else F.xxhash64("root", F.lit(k))
        chosen = F.max_by(F.struct("id", "n", "at", "root"), F.struct(first.alias("first"), "met", "id")).alias("one")
        ones = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), chosen).where("lo <> hi")
        ones = ones.select("key", *(F.col(f"one.{c}").alias(f"{c}2") for c in ("id", "n", "at", "root")))
        star = rooted.join(ones, "key").where((F.col("root") != F.col("root2")) & _possible(F.col("n"), F.col("at"), F.col("n2"), F.col("at2")))
        pairs = checkpoint(star.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct())
        new = verified(docs, pairs, width)
        found = new if found is None else found.union(new)
        old, rooted = rooted, _rooted(rooted.drop("root"), found)
        drop_staged(old)

    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("crowd")).where("lo <> hi").select("key", "crowd")
    left = checkpoint(rooted.join(mixed, "key").select("key", "id", "n", "at", "root", "crowd"))
    few = left.where(F.col("crowd") <= FEW)
    right = few.select("key", *(F.col(c).alias(f"{c}2") for c in ("id", "n", "at", "root")))
    joined = few.join(right, "key").where((F.col("id") < F.col("id2")) & (F.col("root") != F.col("root2")) & _possible(F.col("n"), F.col("at"), F.col("n2"), F.col("at2")))
    joined = joined.select(F.col("id").alias("a"), F.col("id2").alias("b"))
    crowded = crowded_pairs(docs, left.where(F.col("crowd") > FEW).select("key", "id", "root", "crowd"), width)
    more = verified(docs, checkpoint(joined.union(crowded).distinct()), width)
    drop_staged(rooted)
    return found.union(more)
