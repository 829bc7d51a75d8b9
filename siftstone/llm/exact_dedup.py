"""Exact dedup: a streaming aggregation whose keyed state lives on disk and never expires.

Each arriving document is reduced to (digest of its normalised text, length, identifier, content locator). The
stream groups by digest; its state, in RocksDB with a change log in the shared folder, keeps for every digest the
number of documents seen, the identifier of the one that stays and where its content lies: file and row. A digest that
was seen before is only a hit: the rows of hits are fetched by their locators and settled on their full bytes against
the text of the row that stays, and digests that more than one text shares are grouped again by the text itself.

Only DataFrame operations are used; foreachBatch hands micro-batches to the driver's code, never rows to Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, drop_staged, remove, scratch, stage

#: A store is closed once its task has committed, so that a worker's disk holds those at work and not all partitions'.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
KEYS = "doc_id bigint, digest string, n_points bigint, locator struct<file:string,row:bigint>"
#: Groups of more rows than this may be joined apart from the others, and that many of them at most: the largest
LARGE_GROUP, LARGE_GROUPS = 1000, 50_000
#: Shares that a large group's rows are dealt to where their texts are compared
SHARES = 32


def normalised(text: Column) -> Column:
    """The text without [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def located(docs: DataFrame) -> DataFrame:
    """docs with the column __at, the file and the row in it where each row lies. Rows that lie in no file are written."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("__at")
    try:
        return docs.select("*", at)
    except AnalysisException:
        return stage(docs, "located").select("*", at)


def arrivals(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """What the stream keeps of each document of located(): (doc_id, digest, n_points, locator)."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        digest(normalised(F.col("text"))).alias("digest"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_points"),
        F.col("__at").alias("locator"),
    )


def preferred(doc_id: Column, n_points: Column, locator: Column) -> Column:
    """Largest for the row that stays: most code points, then smallest doc_id; null ids come last; then by place."""
    return F.struct(n_points.alias("n_points"), (-doc_id).alias("minus_id"), locator.alias("locator"))


def follow(stream: DataFrame, state_dir: str, groups_dir: str, **trigger) -> None:
    """Run a stream of arrivals into groups_dir; start it again with the same folders and it goes on where it ended.

    Each micro-batch writes, under its own number, the digests that it changed. A replayed batch overwrites itself.
    """
    spark = stream.sparkSession
    seen = stream.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.max(preferred(F.col("doc_id"), F.col("n_points"), F.col("locator"))).alias("best")
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("at", F.lit(number)).write.mode("overwrite").parquet(f"{groups_dir}/batch={number}")

    old = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = (
            seen.writeStream.outputMode("update")
            .option("checkpointLocation", state_dir)
            .foreachBatch(write)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def current(spark: SparkSession, groups_dir: str) -> DataFrame:
    """The latest state of every digest: (digest, n, keep_id, locator)."""
    schema = "digest string, n bigint, best struct<n_points bigint, minus_id bigint, locator struct<file:string,row:bigint>>, at int"
    rows = spark.read.schema(schema).parquet(f"{groups_dir}/batch=*")
    last = rows.groupBy("digest").agg(F.max_by(F.struct("n", "best"), "at").alias("last"))
    return last.select("digest", F.col("last.n").alias("n"), (-F.col("last.best.minus_id")).alias("keep_id"), F.col("last.best.locator").alias("locator"))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 64) -> DataFrame:
    """One row per row of docs (doc_id bigint, text): doc_id, keep_id, group_size, kept, text_sha256, locator.

    Null text counts as empty; all texts without any character but white space are equal. Of rows with equal texts
    exactly one is kept: most code points, then smallest doc_id, null last; of rows that share both, the last by place
    (file, row). Rows that share a doc_id count one by one in group_size. An empty table gives no rows. Other columns
    are not read. A weaker digest gives the same result more slowly, as hits are settled on full texts. locator is
    where the row lies, by which results meet their rows.
    """
    spark = docs.sparkSession
    docs = located(docs.select("doc_id", "text"))
    keys = stage(arrivals(docs, digest), "arrivals")
    folder = scratch(spark, "exact-dedup")
    path = keys.inputFiles()[0].rsplit("/", 1)[0] if keys.inputFiles() else None
    if path is None:
        return spark.createDataFrame([], f"{RESULT}, locator struct<file:string,row:bigint>")
    stream = spark.readStream.schema(KEYS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    follow(stream, f"{folder}/state", f"{folder}/groups")
    groups = checkpoint(current(spark, f"{folder}/groups"))
    remove(spark, folder)

    known = _with_group(keys, groups)
    # the rows of a large group are dealt to shares, each of which has the text of the row that stays
    share = F.when(F.col("n") > LARGE_GROUP, F.pmod(F.xxhash64("locator"), F.lit(SHARES))).otherwise(0).cast("int")
    hits = known.where("n > 1").select(F.col("locator").alias("__at"), "digest", (F.col("locator") == F.col("best")).alias("stays"), share.alias("share"), (F.col("n") > LARGE_GROUP).alias("large"))
    held = stage(docs.join(hits, "__at").select("digest", "stays", "share", "large", normalised(F.col("text")).alias("norm")), "hits")
    shares = F.when(F.col("large"), F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))
    reps = stage(held.where("stays").select("digest", F.explode(shares).alias("share"), F.col("norm").alias("rep")), "reps")
    differ = held.join(reps, ["digest", "share"]).where(F.col("norm") != F.col("rep"))
    clash = checkpoint(differ.select("digest").distinct())
    drop_staged(held)
    drop_staged(reps)

    if digest is not sha256 or not clash.isEmpty():
        out = _settled(docs, digest, groups, clash)
    else:
        out = known.withColumnRenamed("n", "group_size")
    return out.select("doc_id", "keep_id", "group_size", (F.col("locator") == F.col("best")).alias("kept"), F.col("digest").alias("text_sha256"), "locator")


RESULT = "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string"


def _with_group(keys: DataFrame, groups: DataFrame) -> DataFrame:
    """keys with n, keep_id and best (the locator that stays) of their digest.

    The largest groups, whose number is bounded, meet their rows without a shuffle; the rows of any other group are
    fewer than theirs.
    """
    groups = groups.withColumnRenamed("locator", "best")
    large = checkpoint(groups.where(F.col("n") > LARGE_GROUP).orderBy(F.desc("n"), "digest").limit(LARGE_GROUPS))
    keys = keys.drop("n_points")
    some = keys.join(F.broadcast(large), "digest")
    rest = keys.join(F.broadcast(large.select("digest")), "digest", "left_anti").join(groups, "digest")
    return some.unionByName(rest)


def _settled(docs: DataFrame, digest: Callable[[Column], Column], groups: DataFrame, clash: DataFrame) -> DataFrame:
    """For digests that several texts share: the groups by full text, beside those of the other digests."""
    norm = normalised(F.col("text"))
    n_points = F.char_length(F.coalesce(F.col("text"), F.lit(""))).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest(norm).alias("digest"), norm.alias("norm"), n_points.alias("n_points"), F.col("__at").alias("locator"))
    mixed = rows.join(clash, "digest", "left_semi")
    by_text = mixed.groupBy("norm").agg(F.count(F.lit(1)).alias("group_size"), F.max(preferred(F.col("doc_id"), F.col("n_points"), F.col("locator"))).alias("first"))
    first = mixed.join(by_text, "norm").select("doc_id", (-F.col("first.minus_id")).alias("keep_id"), "group_size", F.sha2("norm", 256).alias("digest"), "locator", F.col("first.locator").alias("best"))
    clean = rows.join(groups.withColumnRenamed("locator", "best").join(clash, "digest", "left_anti"), "digest")
    return first.unionByName(clean.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.sha2("norm", 256).alias("digest"), "locator", "best"))
