"""One query for each operator: op(spark, sf_dir) -> DataFrame, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, html_blocks, langid, lbl, mixing, simhash, substrings, url_filter, warc

#: The rule list of op10: (verdict, host, path)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(listed, 256).alias("items_sha256"), "contaminated")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = langid.learn(docs, ~held_out)
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"), html_blocks.train().p)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("locator")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), mixing.TARGETS)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "sampled")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op1_warc": op1_warc, "op2_log_bilinear": op2_log_bilinear, "op3_decontaminate": op3_decontaminate, "op4_language_id": op4_language_id, "op5_html_text": op5_html_text, "op6_suffix_dedup": op6_suffix_dedup, "op7_exact_dedup": op7_exact_dedup, "op8_mixing": op8_mixing, "op9_simhash": op9_simhash, "op10_url_filter": op10_url_filter}

ORACLES = {
    "op1_warc": r"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
b as (select *, max(page_id) over (partition by payload_digest) as best from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> best then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> best then best end as refers_to
from b
""",
    "op3_decontaminate": r"""
with split as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
items as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
windows as (
  select distinct item_id, least(13, len(w)) as n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as phrase
  from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) as i from items where len(w) > 0)),
lengths as (select distinct n from windows),
places as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as phrase
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from split, lengths where len(w) >= n)),
found as (select p.doc_id, p.i, p.n, v.item_id from places p join windows v using (n, phrase)),
hit as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as k from found) group by doc_id),
named as (
  select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, cast(item_id as varchar) as id from found where item_id is not null) group by doc_id)
select s.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from split s left join hit using (doc_id) left join named using (doc_id)
""",
    "op7_exact_dedup": r"""
with docs as (
  select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
keyed as (select doc_id, length(text) as n_points, sha256(norm) as text_sha256 from docs)
select doc_id, first_value(doc_id) over (partition by text_sha256 order by n_points desc, doc_id) as keep_id,
  count(*) over (partition by text_sha256) as group_size,
  doc_id = first_value(doc_id) over (partition by text_sha256 order by n_points desc, doc_id) as kept, text_sha256
from keyed
""",
    "op10_url_filter": r"""
with cut as (
  select page_id, case when url is null or strpos(url, '://') = 0 then '' else substr(url, strpos(url, '://') + 3) end as rest from pages),
parts as (
  select page_id, regexp_extract(rest, '^([^/?#]*)', 1) as raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
hosts as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from parts),
judged as (
  select page_id, host, path,
    case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
         when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
         when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
         when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
  from hosts)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from judged
""",
}
