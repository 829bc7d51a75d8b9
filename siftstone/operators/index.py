"""The stored index: tables that are written once, sorted by what queries look up, and read by pushed filters.

An index is a folder of Parquet tables in four parts: names, postings, lengths and vocab. Grams and terms are dealt to ranges of their key and
path and sorted in them, so a query's filter on a few keys is answered from the statistics of row groups: it reads the posting lists of
its own keys only. Each part is written when a table of it is first asked for, so that a search of names reads no text, and the words
alone are counted without postings. A part goes to a folder of its own and is renamed when whole, so a crash leaves no half of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import shared
from . import search

#: Number of the layout and analysis of the tables; an index of another number isn't read
FORMAT = 3
TABLES = ("grams", "postings", "lengths", "vocab", "stats", "files")
PARTS = ("names", "postings", "lengths", "vocab")


class Index:
    """grams(gram, path, dl), postings(term, path, tf, dl), lengths(path, dl), vocab(term, df), stats(kind, n, avgdl), files.

    files: a row for each path, without its text. write(part) writes a part that isn't there yet; without it all are.
    """

    def __init__(self, spark: SparkSession, path: str, write: Callable[[str], None] | None = None) -> None:
        self.spark, self.path, self.write = spark, path, write

    def _table(self, part: str, name: str) -> DataFrame:
        if self.write:
            self.write(part)
        return self.spark.read.parquet(f"{self.path}/{part}/{name}")

    @property
    def files(self) -> DataFrame:
        return self._table("names", "files")

    @property
    def grams(self) -> DataFrame:
        return self._table("names", "grams")

    @property
    def postings(self) -> DataFrame:
        return self._table("postings", "postings")

    @property
    def lengths(self) -> DataFrame:
        return self._table("lengths", "lengths")

    @property
    def vocab(self) -> DataFrame:
        return self._table("vocab", "vocab")

    @property
    def stats(self) -> DataFrame:
        return self._table("names", "stats").union(self._table("lengths", "stats"))

    def stats_of(self, kind: str) -> DataFrame:
        """(n, avgdl) of the names or the contents."""
        return self._table({"name": "names", "content": "lengths"}[kind], "stats").select("n", "avgdl")


def _write(df: DataFrame, path: str, key: str) -> None:
    order = [key] if key == "path" else [key, "path"]
    # ranges are of key and path, so that a key of a third of all rows is cut into many
    df.repartitionByRange(*map(F.col, order)).sortWithinPartitions(*order).write.option("compression", "zstd").option("parquet.block.size", 8 << 20).option("parquet.page.size", 64 << 10).parquet(path)


def _write_vocab(vocab: DataFrame, path: str) -> None:
    vocab.repartitionByRange(F.col("term")).sortWithinPartitions("term").write.option("parquet.block.size", 8 << 20).parquet(path)


def _write_stats(lengths: DataFrame, kind: str, path: str) -> None:
    lengths.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).coalesce(1).write.parquet(path)


def _half(spark: SparkSession, path: str) -> str:
    return f"{path}.{shared.scratch(spark, 'build').rsplit('-', 1)[1]}"


def _composed(files: DataFrame, spaced: bool) -> DataFrame:
    return files if spaced else files.withColumns({c: text.compose(F.col(c)) for c in ("name", "stem", "text")})


def _texts(composed: DataFrame) -> DataFrame:
    """(path, text): a row for each path. Texts of rows with one path are joined by a line, which parts terms."""
    rows = composed.select("path", "text")
    if rows.groupBy("path").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("path").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    return rows


def _write_names(composed: DataFrame, half: str) -> None:
    spark = composed.sparkSession
    _write(composed.drop("text").dropDuplicates(["path"]), f"{half}/names/files", "path")
    _write(search.name_grams(spark.read.parquet(f"{half}/names/files")), f"{half}/names/grams", "gram")
    _write_stats(spark.read.parquet(f"{half}/names/grams").select("path", "dl").distinct(), "name", f"{half}/names/stats")


def _write_lengths(lengths: DataFrame, half: str) -> None:
    lengths.write.parquet(f"{half}/lengths/lengths")
    _write_stats(lengths.sparkSession.read.parquet(f"{half}/lengths/lengths"), "content", f"{half}/lengths/stats")


def _write_content(composed: DataFrame, half: str, spaced: bool) -> None:
    """All parts that come from texts."""
    spark = composed.sparkSession
    # texts are dealt by path, which is less than their terms; terms are then counted where their text lies
    terms = search.terms_of(_texts(composed).repartition("path"), spaced).select("path", F.size("terms").cast("bigint").alias("dl"), F.explode("terms").alias("term"))
    # the terms of the corpus are extracted once; all tables come from what was written
    terms.groupBy("term", "path", "dl").agg(F.count(F.lit(1)).alias("tf")).write.option("compression", "zstd").parquet(f"{half}/terms")
    posted = spark.read.parquet(f"{half}/terms").select("term", "path", "tf", "dl")
    _write_lengths(posted.select("path", "dl").distinct(), half)
    _write_vocab(search.vocab(posted), f"{half}/vocab/vocab")
    _write(posted, f"{half}/postings/postings", "term")


def _ensure(part: str, files: DataFrame, path: str, spaced: bool) -> None:
    """Write a part of the index of files to path, from nothing; one that is there already is kept."""
    spark = files.sparkSession
    if shared.exists(spark, f"{path}/{part}"):
        return
    half, composed = _half(spark, path), _composed(files, spaced)
    if part == "names":
        _write_names(composed, half)
    elif part == "postings":
        _write_content(composed, half, spaced)
    elif part == "lengths":
        _write_lengths(search.terms_of(_texts(composed), spaced).select("path", F.size("terms").cast("bigint").alias("dl")).where("dl > 0"), half)
    else:
        once = search.terms_of(_texts(composed), spaced).select(F.explode(F.array_distinct("terms")).alias("term"))
        _write_vocab(search.vocab(once), f"{half}/vocab/vocab")
    shared.make(spark, path)
    for p in PARTS:
        if shared.exists(spark, f"{half}/{p}"):
            shared.rename(spark, f"{half}/{p}", f"{path}/{p}")
    shared.remove(spark, half)


def build(files: DataFrame, path: str, spaced: bool = False) -> Index:
    """Write the whole index of files(path, name, stem, text, ...) to path, from nothing; parts that are there already are kept.

    Names and texts are composed (NFKC) on the way. spaced: no text that this changes, and none of a script without
    spaces, is to be expected. Of rows with one path one is a file of the index, and their postings are one document's.
    """
    for part in PARTS:
        _ensure(part, files, path, spaced)
    return open_(files.sparkSession, path)


def open_(spark: SparkSession, path: str) -> Index:
    return Index(spark, path)


def of(files: DataFrame, source: DataFrame, spaced: bool = False) -> Index:
    """The index of files, which are derived from the table source row by row; parts are written as they are asked for.

    They are found again by source's files. Indexes of a source's earlier files are left to prune().
    """
    path = path_of(source)
    return Index(files.sparkSession, path, lambda part: _ensure(part, files, path, spaced))


def path_of(source: DataFrame) -> str:
    """Where the index of files derived from source lies, built or not."""
    return f"{shared.shared_dir(source.sparkSession)}/index-{FORMAT}-{shared.version(source)}"


def upsert(index: Index, files: DataFrame, gone: DataFrame, path: str, spaced: bool = False) -> Index:
    """Write the index with files(path, name, text) added or replaced and gone(path) removed, to path.

    Rows of other paths are copied as they are; a path is deleted before it is added.
    """
    spark = files.sparkSession
    changed = files.select("path").union(gone.select("path")).distinct()
    keep = lambda df: df.join(changed, "path", "left_anti")
    half = _half(spark, path)
    files = _composed(files, spaced)
    _write(keep(index.files).unionByName(files.drop("text")), f"{half}/names/files", "path")
    _write(keep(index.grams).unionByName(search.name_grams(files)), f"{half}/names/grams", "gram")
    _write_stats(spark.read.parquet(f"{half}/names/grams").select("path", "dl").distinct(), "name", f"{half}/names/stats")
    terms = search.postings(files.select("path", "text"), spaced)
    new = terms.join(search.doc_len(terms), "path").select("term", "path", "tf", "dl")
    _write(keep(index.postings).unionByName(new), f"{half}/postings/postings", "term")
    posted = spark.read.parquet(f"{half}/postings/postings")
    _write_lengths(posted.select("path", "dl").distinct(), half)
    _write_vocab(search.vocab(posted), f"{half}/vocab/vocab")
    shared.rename(spark, half, path)
    return open_(spark, path)


def unreferenced(index: Index, catalogue: DataFrame) -> DataFrame:
    """(path) of indexed documents that the catalogue doesn't have; none if the catalogue is empty, which is no proof."""
    known = catalogue.select("path")
    some = known.limit(1).agg((F.count(F.lit(1)) > 0).alias("some"))
    return index.lengths.select("path").join(known, "path", "left_anti").crossJoin(F.broadcast(some)).where("some").select("path")


def missing(index: Index, catalogue: DataFrame) -> DataFrame:
    """Catalogue rows whose names the index lacks: what repairs a deflated index."""
    return catalogue.join(index.grams.select("path").distinct(), "path", "left_anti")


def worth_compacting(segments: DataFrame) -> DataFrame:
    """(changed, docs, worth) of segments(docs, deleted): a tenth changed, outside the largest segment or deleted."""
    n = segments.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.max("docs"), F.lit(0)).alias("largest"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted"))
    n = n.select(F.greatest(F.col("docs") - F.col("largest"), "deleted").alias("changed"), "docs")
    return n.withColumn("worth", (F.col("changed") > 0) & (F.col("changed") * 10 >= F.col("docs")))


def compaction(segments: DataFrame) -> DataFrame:
    """(action) for segments(docs, deleted): all are merged if that is worth it, else the small ones if there are three or more."""
    n = worth_compacting(segments).crossJoin(segments.agg(F.count(F.lit(1)).alias("segments")))  # two single rows
    return n.select(F.when(F.col("worth"), "merge all").when(F.col("segments") >= 3, "join small").otherwise("nothing").alias("action"))


def compact(index: Index, path: str) -> Index:
    """Write the index anew to path, its keys dealt and sorted as in a build, without rows of paths that it doesn't list."""
    none = index.files.limit(0)
    return upsert(index, none.withColumn("text", F.lit(None).cast("string")), none.select("path"), path, True)
