"""The collection that the engine searches, derived from the given tables row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text

#: Extension of a document by doc_id modulo 5, and its type (fixed values)
EXTS = ("txt", "md", "html", "pdf", "odt")
MIMES = ("text/plain", "text/markdown", "text/html", "application/pdf", "application/vnd.oasis.opendocument.text")
_WORD = r"[\p{L}\p{N}]+"
_GAP = r"[^\p{L}\p{N}]+"
FIRST_WORDS = rf"^[^\p{{L}}\p{{N}}]*({_WORD})(?:{_GAP}({_WORD}))?(?:{_GAP}({_WORD}))?"
EPOCH = 1_704_067_200
NOW = EPOCH + 1000 * 3600


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...]):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % 5 + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str, body: bool = False) -> DataFrame:
    """(doc_id, path, name, stem, ext, mime, source, mtime, size[, text]): a file for each document."""
    docs = read(spark, sf_dir, "documents")
    first = [F.regexp_extract("text", FIRST_WORDS, k) for k in (1, 2, 3)]
    lead = F.array_join(text.drop_empty(F.array(*first)), "_")
    named = docs.withColumns({"ext": _pick(EXTS), "mime": _pick(MIMES), "stem": F.concat(lead, F.lit("-"), F.col("doc_id").cast("string"))})
    named = named.withColumn("name", F.concat("stem", F.lit("."), "ext"))
    return named.select(
        "doc_id",
        F.concat(F.lit("/home/"), "source", F.lit("/"), "lang", F.lit("/"), "name").alias("path"),
        "name", "stem", "ext", "mime", "source",
        (F.lit(EPOCH) + F.col("doc_id") * 3600).alias("mtime"),
        F.octet_length("text").cast("bigint").alias("size"),
        *(["text"] if body else []),
    )


FILES_SQL = rf"""files as (
  select doc_id, '/home/' || source || '/' || lang || '/' || stem || '.' || ext as path, stem || '.' || ext as name, stem, ext, mime, source,
    {EPOCH} + doc_id * 3600 as mtime, cast(strlen(text) as bigint) as size, text
  from (select doc_id, source, lang, text,
      array_to_string(list_filter([regexp_extract(text, '{FIRST_WORDS}', 1), regexp_extract(text, '{FIRST_WORDS}', 2), regexp_extract(text, '{FIRST_WORDS}', 3)], lambda x: x <> ''), '_') || '-' || doc_id as stem,
      {list(EXTS)}[doc_id % 5 + 1] as ext, {list(MIMES)}[doc_id % 5 + 1] as mime from documents))"""


def known(files: DataFrame) -> DataFrame:
    """The catalogue as of before: some files missing, some with another size."""
    return files.where("doc_id % 7 <> 0").select("doc_id", "path", "mtime", (F.col("size") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)).cast("bigint").alias("size"))


def seen(files: DataFrame) -> DataFrame:
    """The latest scan: some files gone."""
    return files.where("doc_id % 13 <> 0").select("doc_id", "path", "mtime", "size")


STATE_SQL = """known as (select doc_id, path, mtime, size + case when doc_id % 11 = 0 then 1 else 0 end as size from files where doc_id % 7 <> 0),
seen as (select doc_id, path, mtime, size from files where doc_id % 13 <> 0)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, file_id, saved_at, size, reason): saved versions, from events."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("file_id"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("saved_at"),
        F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("bigint").alias("size"),
        F.when(F.col("event_type") == "signup", "before_restore").when(F.col("event_type") == "view", "baseline").otherwise("saved").alias("reason"),
    )


VERSIONS_SQL = """versions as (select event_id as id, user_id as file_id, cast(floor(epoch(ts)) as bigint) as saved_at, cast(round(coalesce(value, 0) * 100) as bigint) as size,
  case event_type when 'signup' then 'before_restore' when 'view' then 'baseline' else 'saved' end as reason from events)"""


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, kind, confidence, label, domain, updated_at): provenance of files, from pages of the same number."""
    f = files(spark, sf_dir)
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), text.domain_from_url(F.col("url")).alias("domain"))
    web = F.col("domain").isNotNull()
    return f.join(p, "doc_id").select(
        "doc_id", "path", F.when(web, "web_download").otherwise("unknown").alias("kind"), F.when(web, 3).otherwise(1).alias("confidence"),
        F.coalesce("domain", F.lit("")).alias("label"), "domain", (F.col("mtime") + 60).alias("updated_at"),
    )
