"""Connected components of an edge table, by alternating large-star and small-star steps.

No step needs the edges of a node together: minima are combined before the shuffle, and what follows is a join that
Spark can split. Each round ends in a checkpoint, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (a bigint, b bigint): root is the smallest node that it reaches.

    Loops, repeated edges and nulls don't matter; nodes without an edge to another node aren't returned.
    """
    e = checkpoint(_distinct(edges.select("a", "b")))
    size = _state(e)
    for _ in range(rounds):
        if not size[0]:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _distinct(both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a").select("a", "b", "m")
        pair = F.inline(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        e = checkpoint(_distinct(joined.select(pair)))
        old, size = size, _state(e)
        if size == old:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _distinct(edges: DataFrame) -> DataFrame:
    """Larger node first, no loops."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(e: DataFrame) -> tuple:
    got = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return got["n"], got["s"]
