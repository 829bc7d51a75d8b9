"""A corpus from documents: language ID, exact dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame, which is
written as Parquet in the shared folder and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm import decontaminate, exact_dedup, langid, mixing, shingles, simhash
from siftstone.llm.common import drop_since, scratch, stage, staged
from siftstone.llm.components import components


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compressor names with a margin; the others go, null, empty and letterless ones too."""
    model = langid.learn(docs)
    return langid.identify(docs, model).where(~F.col("rejected")).select(docs.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number __row that no other row has, written down so that every reader sees the same."""
    return stage(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """rows but those whose __row is in dropped, as documents: what is decided of a row holds for no other."""
    return rows.join(dropped.select("__row"), "__row", "left_anti").drop("__row")


def by_row(rows: DataFrame) -> DataFrame:
    """rows for an operator that is to tell them apart: their number as doc_id."""
    return rows.withColumn("doc_id", F.col("__row")).drop("__row")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts exactly one stays: the longest as it stands, then that with the smallest doc_id, null last."""
    rows = exact_dedup.located(docs)
    dropped = exact_dedup.exact_dedup(rows).where(~F.col("kept")).select(F.col("locator").alias("__at"))
    return rows.join(dropped, "__at", "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by their fingerprints, or by a similarity of 0.8 or more of their sets of five-word shingles, one stays.

    Fingerprints link as in op9, by simhash.near_dedup; the sets add the near copies that four bits do not reach, and
    links of either kind make one component. The row that stays is the one with the smallest doc_id; a null doc_id stays only if no linked row has another.
    """
    rows = numbered(docs)
    near = simhash.near_dedup(by_row(rows).select("doc_id", "text")).where("doc_id <> component_id")
    near = stage(near.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")), "near")
    alike = shingles.near_links(rows.select(F.col("__row").alias("id"), "text"))
    linked = stage(components(near.union(alike)).withColumnRenamed("node", "__row"), "linked")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row").alias("first"))
    kept = linked.join(rows.select("__row", "doc_id"), "__row").groupBy("root").agg(first.alias("first")).select("first.__row")
    return without(rows, linked.join(kept, "__row", "left_anti")).select(docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs: one of any other document's length gives its answer away.

    Null and empty texts have no windows and stay.
    """
    rows = numbered(docs)
    found = decontaminate.contamination(by_row(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(rows, found.where("n_hit > 0").withColumnRenamed("doc_id", "__row")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents with their topic, token weight and inclusion probability."""
    return mixing.mix(docs, mixing.TARGETS).where("sampled").drop("sampled")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_free),
    ("mixing", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for k, (name, apply) in enumerate(STAGES):
        path, before = f"{folder}/{k}-{name}", staged()
        apply(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        drop_since(spark, before)
    return docs


#: Compression, fingerprints and raking have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None
