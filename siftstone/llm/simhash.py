"""SimHash near-dedup with deletion variants.

Fingerprints of 64 bits that differ in at most 4 agree in one of three segments up to one bit, as four differences
cannot put two into each. So each fingerprint is indexed, for every segment and every bit of it, under the segment
with that bit as a wildcard (64 variants); two fingerprints that link share a variant, an equality join finds them
and the whole fingerprints settle it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, each, lean, stage
from .components import components

BITS = 64


def word_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of width words; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    k = min(width, len(words))
    f = xxhash.xxh64_intdigest
    return np.array([f(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def fingerprint(text: str | None, width: int = 4) -> int:
    """A bit is 1 if over half of the shingles' hashes set it; 0 without words."""
    hashes = word_hashes(text, width)
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[k : k + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long."""

    def run(batches):
        for batch in batches:
            out = np.fromiter((fingerprint(t, width) for t in each(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(lean(run), "doc_id bigint, fp bigint")


#: (first bit, bits) of each segment
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Bits that two linked fingerprints may differ in; the segments are cut for it.
DISTANCE = 4
#: Over so many distinct fingerprints, variants also hold an exact part of the other bits.
REFINE_FROM = 1 << 24


def _mask(first: int, bits: int) -> int:
    return ((1 << bits) - 1) << first


def _lit(mask: int):
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint")


def variants(fps: DataFrame, refine: bool = False) -> DataFrame:
    """fps (fp, ...) with, for each wildcard bit, the column slot (that bit) and key (the rest of its segment).

    refine: the bits outside the segment, of which at most four differ, are cut into five parts; one agrees, and the
    key holds it too. That makes five times the rows and a 256th of the chance matches.
    """
    rows = []
    for first, bits in SEGMENTS:
        other = [b for b in range(BITS) if not first <= b < first + bits]
        parts = [sum(1 << b for b in other[len(other) * i // 5 : len(other) * (i + 1) // 5]) for i in range(5)]
        for bit in range(first, first + bits):
            segment = F.col("fp").bitwiseAND(_lit(_mask(first, bits) & ~(1 << bit)))
            if refine:
                rows += [F.struct(F.lit(bit).alias("slot"), F.xxhash64(segment, F.lit(i), F.col("fp").bitwiseAND(_lit(p))).alias("key")) for i, p in enumerate(parts)]
            else:
                rows.append(F.struct(F.lit(bit).alias("slot"), segment.alias("key")))
    return fps.select("*", F.inline(F.array(*rows)))


def _first_slot(x):
    """The slot under which a pair with difference x is reported: of the first segment with at most one bit."""
    out = F.lit(-1)
    for first, bits in reversed(SEGMENTS):
        part = x.bitwiseAND(_lit(_mask(first, bits)))
        at = F.when(part == 0, F.lit(first)).otherwise(F.bit_count(part - 1))
        out = F.when(F.bit_count(part) <= 1, at).otherwise(out)
    return out


def close_classes(fps: DataFrame) -> DataFrame:
    """(a, b) for fingerprints that differ only within one group of four bits: a group has 16 members at most.

    These links alone draw dense groups together, so that the join below need not report their pairs.
    """
    rows = [F.struct(F.lit(n).alias("part"), F.col("fp").bitwiseAND(_lit(((1 << 64) - 1) ^ (15 << (4 * n)))).alias("key")) for n in range(16)]
    groups = fps.select("fp", F.inline(F.array(*rows))).groupBy("part", "key").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("members"))
    return groups.where(F.size("members") > 1).select(F.explode("members").alias("a"), "b").where("a <> b")


def links(fps: DataFrame, refine: bool = False) -> DataFrame:
    """(a, b) for all fingerprints of fps (fp distinct, root) with different roots that differ in at most DISTANCE bits."""
    left = variants(fps, refine)
    right = left.select(F.col("fp").alias("fp2"), F.col("root").alias("root2"), "slot", "key")
    x = F.col("fp").bitwiseXOR(F.col("fp2"))
    found = left.join(right, ["slot", "key"]).where((F.col("fp") < F.col("fp2")) & (F.col("root") != F.col("root2")) & (F.bit_count(x) <= DISTANCE) & (F.col("slot") == _first_slot(x)))
    return found.select(F.col("fp").alias("a"), F.col("fp2").alias("b"))


def near_dedup(docs: DataFrame, width: int = 4, refine: bool | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fp, component_id (the smallest doc_id reachable).

    Null, empty and blank texts have fingerprint 0, which links like any other; texts of fewer than width words have
    one shingle. Copies share a fingerprint and are one node. A null doc_id is never a component_id unless the whole
    component has no other. Repeated rows are returned as often as they come; an empty table gives no rows.
    """
    all_fps = stage(fingerprints(docs, width), "fingerprints")
    classes = checkpoint(all_fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    if refine is None:
        refine = classes.count() > REFINE_FROM
    near = close_classes(classes.select("fp"))
    near = checkpoint(near)
    roots = components(near)
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    cross = links(rooted, refine)
    roots = components(near.union(cross))
    classes = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return all_fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
