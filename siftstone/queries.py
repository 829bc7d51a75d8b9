"""One query for each operator of the engine, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .docinfo import columns as info
from .docinfo.analyze import analyze
from .functions import paths, text
from .operators import catalogue, history, mime, origin, search
from .operators import index as stored_index
from .plans.request import Filter, Page, Request, Tables, answer, totals, with_available
from .registry import ORACLES, QUERIES, query
from .sources import tables as src
from .streaming import reconcile

__all__ = ["ORACLES", "QUERIES", "flagship"]


TERMS_SQL = rf"""terms as (select path, unnest(list_filter(regexp_extract_all({text.fold_sql("text")}, '[\p{{L}}\p{{N}}]+'), lambda t: strlen(t) < 40)) as term from files),
postings as (select term, path, count(*) as tf from terms group by term, path),
lengths as (select path, sum(tf) as dl from postings group by path),
vocab as (select term, count(*) as df from postings group by term),
stats as (select count(*) as n, avg(dl) as avgdl from lengths)"""
BM25_SQL = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"
PUNCT = r"""[\s\p{Z}!-/:-@\[-`{-~–—‐·•«»“”‘’、。，（）【】「」]+"""
NAME_SQL = rf"""named as (select *, list_filter(string_split_regex({text.fold_sql("name")}, '{PUNCT.replace("'", "''")}'), lambda x: x <> '') as words,
  list_filter(string_split_regex({text.fold_sql("stem")}, '{PUNCT.replace("'", "''")}'), lambda x: x <> '') as swords from files),
ntexts as (select *, case when len(words) = 0 then ' ' else ' ' || array_to_string(words, ' ') || ' ' end as ntext from named),
grams as (select path, unnest(gs) as gram, len(gs) as dl from (
  select path, list_distinct(list_concat(list_transform(generate_series(1, length(ntext) - 1), lambda i: substr(ntext, i, 2)),
    case when length(ntext) >= 3 then list_transform(generate_series(1, length(ntext) - 2), lambda i: substr(ntext, i, 3)) else [] end)) as gs from ntexts where length(ntext) >= 2))"""


def files(spark: SparkSession, d: str, body: bool = False) -> DataFrame:
    return src.files(spark, d, body)


def index(spark: SparkSession, d: str) -> stored_index.Index:
    """The stored index of the collection, which the first query over a table writes and all later ones read."""
    return stored_index.of(files(spark, d, True), src.read(spark, d, "documents"))


def found(i: stored_index.Index, *words: str, tf: bool = True, limit: int | None = 20) -> DataFrame:
    terms = [(k, w, 1.0) for k, w in enumerate(words)]
    return search.search_content(i.postings, i.lengths, terms, tf, limit, i.stats_of("content"))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# content


@query(f"""with {src.FILES_SQL}, {TERMS_SQL},
hit as (select path, sum({BM25_SQL}) as score, count(*) as k from postings join vocab using (term) join lengths using (path), stats where term in ('the', 'of') group by path)
select path, round(score, 6) as score from hit where k = 2 order by score desc, path limit 20""")
def content_and_bm25(spark, d):
    return rounded(found(index(spark, d), "the", "of"), "score")


@query(f"""with {src.FILES_SQL}, {TERMS_SQL},
ones as (select term, path, 1 as tf from postings),
hit as (select path, sum({BM25_SQL}) as score, count(*) as k from ones join vocab using (term) join lengths using (path), stats where term in ('der', 'die') group by path)
select path, round(score, 6) as score from hit where k = 2 order by score desc, path limit 20""")
def content_basic_mode(spark, d):
    return rounded(found(index(spark, d), "der", "die", tf=False), "score")


@query(f"""with {src.FILES_SQL}, {TERMS_SQL},
begun as (select term, df, row_number() over (order by df desc, term) as rn from vocab where starts_with(term, 'ther')),
budget as (select term, rn, sum(df) over (order by rn) as s from begun where rn <= 32),
forms as (
  select 0 as word, term from vocab where term in ({", ".join(f"'{w}'" for w in search.inflections("that"))})
  union select 1, term from vocab where term in ({", ".join(f"'{w}'" for w in search.inflections("ther"))})
  union select 1, term from budget where rn = 1 or s <= 50000),
others as (select distinct word, term from forms where not (word = 0 and term = 'that') and not (word = 1 and term = 'ther')),
wanted as (select word, term, 1.0 as boost from others
  union all select 0, 'that', case when exists (select 1 from others where word = 0) then 2.0 else 1.0 end
  union all select 1, 'ther', case when exists (select 1 from others where word = 1) then 2.0 else 1.0 end),
hit as (select path, sum(boost * {BM25_SQL}) as score, count(distinct word) as k from postings join wanted using (term) join vocab using (term) join lengths using (path), stats group by path)
select path, round(score, 6) as score from hit where k = 2 order by score desc, path limit 20""")
def content_word_forms(spark, d):
    i = index(spark, d)
    return rounded(search.search_content(i.postings, i.lengths, search.query_terms(i.vocab, ["that", "ther"]), limit=20, stats=i.stats_of("content")), "score")


@query(f"""with {src.FILES_SQL}, {TERMS_SQL}
select least(count(*), 5000) as n from (select path from postings where term in ('the', 'and') group by path having count(*) = 2)""")
def content_phrase_free_count(spark, d):
    return search.capped_count(found(index(spark, d), "the", "and", limit=None))


@query(f"""with {src.FILES_SQL}, {TERMS_SQL},
begun as (select term, df, row_number() over (order by df desc, term) as rn from vocab where starts_with(term, 'the')),
budget as (select term, df, rn, sum(df) over (order by rn) as s from begun where rn <= 32)
select term, df from budget where rn = 1 or s <= 50000""")
def prefix_vocab(spark, d):
    return search.beginning(index(spark, d).vocab, "the")


@query(f"with {src.FILES_SQL}, {TERMS_SQL} select term, df from vocab")
def doc_freq(spark, d):
    return index(spark, d).vocab


# names


@query(f"with {src.FILES_SQL}, {NAME_SQL} select gram, count(*) as n from grams group by gram")
def name_grams(spark, d):
    return search.name_grams(files(spark, d)).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


NAME_HITS = f"""{NAME_SQL},
gstats as (select count(*) as n, avg(dl) as avgdl from (select distinct path, dl from grams)),
gdf as (select gram, count(*) as df from grams group by gram),
scored as (select path, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avgdl))) as base, count(*) as k
  from grams join gdf using (gram), gstats where gram in ('the', ' in', 'in ') group by path having count(*) = 3),
judged as (select s.*, f.mtime, array_to_string(swords, ' ') = 'the in' as whole,
    case when list_contains(words, 'the') then 3 when len(list_filter(words, lambda x: starts_with(x, 'the'))) > 0 then 2 when contains(ntext, 'the') then 1 end
      + case when list_contains(words, 'in') then 3 end as quality,
    base + case when contains(ntext, ' th') then 1000 else 0 end + case when contains(ntext, 'he ') then 1000 else 0 end
      + case when array_to_string(swords, ' ') = 'the in' then 100000 else 0 end as score
  from scored s join ntexts f using (path)),
names as (select * from judged where quality is not null)"""


@query(f"with {src.FILES_SQL}, {NAME_HITS} select path, whole, quality, round(score, 6) as score from names order by whole desc, quality desc, score desc, mtime // 86400 desc, path limit 50")
def name_search_rank(spark, d):
    i = index(spark, d)
    return rounded(search.search_names(i.files, ["the", "in"], grams=i.grams, stats=i.stats_of("name")).select("path", "whole", "quality", "score"), "score")


@query(f"with {src.FILES_SQL}, {NAME_SQL} select least(count(*), 5000) as n from (select path from grams where gram in ('the', 'her', 'ere') group by path having count(*) = 3)")
def name_count(spark, d):
    grams = index(spark, d).grams
    must = search.plan_name(["there"]).must
    found = grams.where(F.col("gram").isin(*must)).groupBy("path").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == len(must))
    return search.capped_count(found)


@query(f"with {src.FILES_SQL}, {NAME_SQL} select doc_id, array_to_string(words, '|') as words, array_to_string(swords, ' ') as stem_key from named")
def name_words(spark, d):
    return files(spark, d).select("doc_id", F.array_join(text.name_words(F.col("name")), "|").alias("words"), F.array_join(text.name_words(F.col("stem")), " ").alias("stem_key"))


@query(f"""with {src.FILES_SQL}, {TERMS_SQL}, {NAME_HITS},
body as (select path, sum({BM25_SQL}) as body_score from postings join vocab using (term) join lengths using (path), stats where term in ('that', 'with') group by path having count(*) = 2),
merged as (select coalesce(n.path, b.path) as path, n.score as name_score, whole, quality, body_score,
  case when n.path is not null and b.path is not null then 0 when n.path is not null then 1 else 2 end as tier from names n full join body b on n.path = b.path)
select path, case tier when 0 then 'both' when 1 then 'name' else 'body' end as match_kind, round(coalesce(name_score, body_score), 6) as score, tier
from merged order by tier, whole desc nulls last, quality desc nulls last, name_score desc nulls last, body_score desc nulls last, path limit 50""")
def both_bands(spark, d):
    i = index(spark, d)
    names = search.search_names(i.files, ["the", "in"], None, i.grams, i.stats_of("name"))
    return rounded(search.search_both(names, found(i, "that", "with", limit=None), 50), "score")


THE_SQL = f"""begun as (select term, df, row_number() over (order by df desc, term) as rn from vocab where starts_with(term, 'the')),
budget as (select term, rn, sum(df) over (order by rn) as s from begun where rn <= 32),
others as (select distinct term from budget where (rn = 1 or s <= 50000) and term <> 'the'),
wanted as (select term, 1.0 as boost from others union all select 'the', case when exists (select 1 from others) then 2.0 else 1.0 end),
hit as (select path, sum(boost * {BM25_SQL}) as score from postings join wanted using (term) join vocab using (term) join lengths using (path), stats group by path)"""
PAGE_SQL = "mtime, ext, mime, source, true as available"


@query(f"""with {src.FILES_SQL}, {TERMS_SQL}, {THE_SQL}
select path, name, round(score, 6) as score, 'body' as match_kind, size, {PAGE_SQL} from hit join files using (path)
where ext in ('md', 'txt') and path >= '/home/src1/' and path < '/home/src10' order by hit.score desc, path offset 2 limit 5""")
def request_content_page(spark, d):
    """The only word also stands for what it begins."""
    return rounded(answer(Tables.of(index(spark, d)), Request("the", "content", Filter(under="/home/src1", ext=("md", ".TXT")), Page(2, 5))), "score")


@query(f"""with {src.FILES_SQL}, {TERMS_SQL}, {THE_SQL}, n as (select least(count(*), 5000) as total from hit join files using (path) where ext = 'md')
select total, case when 60 < total then 60::bigint end as next_offset from n""")
def request_total(spark, d):
    return totals(Tables.of(index(spark, d)), Request("The", "content", Filter(ext=("md",)), Page(50, 10)))


@query(f"""with {src.FILES_SQL}, {NAME_HITS}
select path, name, round(n.score, 6) as score, 'name' as match_kind, size, f.mtime, ext, mime, source, true as available from names n join files f using (path)
where size between 100 and 100000 order by whole desc, quality desc, n.score desc, f.mtime // 86400 desc, path offset 1 limit 20""")
def request_name_page(spark, d):
    return rounded(answer(Tables.of(index(spark, d)), Request("The_in", "anything", Filter(size=(100, 100_000)), Page(1, 20))), "score")


@query(f"""with {src.FILES_SQL}, {TERMS_SQL}, {NAME_HITS}, {THE_SQL.replace("hit as", "the_hit as")},
in_forms as (select term, df, row_number() over (order by df desc, term) as rn from vocab where term in ({", ".join(f"'{w}'" for w in search.inflections("in")) or "''"})),
two as (select path, sum({BM25_SQL}) as score from postings join vocab using (term) join lengths using (path), stats where term = 'in' group by path),
one as (select path, sum(boost * {BM25_SQL}) as score from postings join (select 'the' as term, case when exists (select 1 from vocab where term in ({", ".join(f"'{w}'" for w in search.inflections("the")) or "''"})) then 2.0 else 1.0 end as boost) w using (term)
  join vocab using (term) join lengths using (path), stats group by path),
body as (select path, one.score + two.score as body_score from one join two using (path)),
merged as (select coalesce(n.path, b.path) as path, n.score as name_score, whole, quality, body_score,
  case when n.path is not null and b.path is not null then 0 when n.path is not null then 1 else 2 end as tier from names n full join body b on n.path = b.path)
select path, name, round(coalesce(name_score, body_score), 6) as score, case tier when 0 then 'both' when 1 then 'name' else 'body' end as match_kind, size, mtime, ext, mime, source, true as available
from merged join files using (path) order by tier, whole desc nulls last, quality desc nulls last, name_score desc nulls last, body_score desc nulls last, path limit 40""")
def request_both_page(spark, d):
    return rounded(answer(Tables.of(index(spark, d)), Request("the in", "both", page=Page(0, 40))), "score")


@query(f"""with {src.FILES_SQL} select path, name, 0.0::double as score, 'name' as match_kind, size, {PAGE_SQL} from files
where not starts_with(path, '/home/src3/') or path like '/home/src3/en/%' order by mtime desc, path limit 30""")
def request_list_page(spark, d):
    """One source is away and shown only where it is retained; the page is taken of what can be shown."""
    i = index(spark, d)
    sources = spark.createDataFrame([("/home/src3", False, False), ("/home/src3/en", False, True), ("/home", True, False)], "prefix string, available boolean, retained boolean")
    shown = with_available(i.files, sources).drop("available")
    return answer(Tables(shown, i.postings, i.lengths, i.vocab), Request("", "list", page=Page(0, 30)))


@query(f"""with {src.FILES_SQL}, page as (select * from files where mime = 'text/markdown' order by size desc, path limit 60)
select path, name, 0.0::double as score, 'name' as match_kind, size, mtime, ext, mime, source, not (starts_with(path, '/home/src2/') or starts_with(path, '/home/src5/')) as available
from page where not starts_with(path, '/home/src2/')""")
def request_largest_page(spark, d):
    """Hits of a source that is away are dropped from the page, those of a retained one are shown as not available."""
    i = index(spark, d)
    sources = spark.createDataFrame([("/home/src2", False, False), ("/home/src5", False, True)], "prefix string, available boolean, retained boolean")
    return answer(Tables.of(i, sources=sources), Request("", "largest", Filter(mime=("text/markdown",)), Page(0, 60)))


HAN = "报告会议记录销售额量部门季度文书信"


@query(f"""with files as (select '/h/' || doc_id as path, '本' || substr('{HAN}', (doc_id % 11)::int + 1, 4) || ' ' || substr('{HAN}', (doc_id // 11 % 13)::int + 1, 3) as text from documents),
runs as (select path, unnest(string_split(text, ' ')) as r from files),
terms as (select path, unnest(list_concat(list_transform(generate_series(1, length(r) - 1), lambda i: substr(r, i, 2)), string_split(r, ''))) as term from runs),
postings as (select term, path, count(*) as tf from terms group by term, path),
lengths as (select path, sum(tf) as dl from postings group by path), vocab as (select term, count(*) as df from postings group by term),
stats as (select count(*) as n, avg(dl) as avgdl from lengths),
hit as (select path, sum({BM25_SQL}) as score, count(*) as k from postings join vocab using (term) join lengths using (path), stats where term in ('销售', '售额') group by path)
select path, round(score, 6) as score from hit where k = 2 order by score desc, path limit 50""")
def content_unspaced(spark, d):
    """Text without spaces: a run of three characters is asked for by its pairs."""
    doc = F.col("doc_id")
    docs = src.read(spark, d, "documents").select(F.concat(F.lit("/h/"), doc.cast("string")).alias("path"), F.concat(F.lit("本"), F.lit(HAN).substr((doc % 11 + 1).cast("int"), F.lit(4)), F.lit(" "), F.lit(HAN).substr((F.floor(doc / 11) % 13 + 1).cast("int"), F.lit(3))).alias("text"))
    p = search.postings(docs)
    terms = [(k, w, 1.0) for k, w in enumerate(search.content_words(spark, "销售额"))]
    return rounded(search.search_content(p, search.doc_len(p), terms), "score")


# listings and filters


@query(f"with {src.FILES_SQL} select path, mtime from files order by mtime desc, path limit 50")
def list_newest(spark, d):
    return catalogue.listing(files(spark, d)).select("path", "mtime")


@query(f"with {src.FILES_SQL} select path, size from files order by size desc, path limit 50")
def list_largest(spark, d):
    return catalogue.listing(files(spark, d), "size").select("path", "size")


@query(f"with {src.FILES_SQL} select distinct path from files where path >= '/home/src3/' and path < '/home/src30' order by path limit 5000")
def list_under(spark, d):
    return catalogue.list_paths(files(spark, d), "/home/src3", 5000)


@query(f"with {src.FILES_SQL} select path from files where ext in ('pdf', 'html')")
def ext_filter(spark, d):
    return files(spark, d).where(catalogue.filters(ext=[".PDF", "html", "", "tar.gz"])).select("path")


@query(f"with {src.FILES_SQL} select path from files where mime = 'application/pdf' or split_part(mime, '/', 1) = 'text'")
def mime_filter(spark, d):
    return files(spark, d).where(catalogue.filters(mime=["application/pdf", "text/*"])).select("path")


@query(f"with {src.FILES_SQL} select path, size from files where size between 1000 and 2000 and mtime between {src.EPOCH} and {src.EPOCH + 500 * 3600}")
def size_range(spark, d):
    return files(spark, d).where(catalogue.filters(size=(1000, 2000), mtime=(src.EPOCH, src.EPOCH + 500 * 3600))).select("path", "size")


@query(f"with {src.FILES_SQL} select path from files where path >= '/home/src4/' and path < '/home/src40' order by mtime desc, path offset 10 limit 10")
def page_offset(spark, d):
    return catalogue.listing(files(spark, d), where=catalogue.filters(under="/home/src4"), offset=10, limit=10).select("path")


@query(f"with {src.FILES_SQL} select least(count(*), 5000) as n from files where ext = 'txt'")
def capped_count(spark, d):
    return search.capped_count(files(spark, d).where(catalogue.filters(ext=["txt"])))


@query(f"with {src.FILES_SQL} select path from files where path > '/home/src2' order by path limit 100")
def page_after(spark, d):
    return catalogue.page_after(files(spark, d).select("path"), "/home/src2", 100)


@query(f"""with {src.FILES_SQL}, below as (select substr(path, 12) as rest from files where path >= '/home/src5/' and path < '/home/src50')
select '/home/src5/' || split_part(rest, '/', 1) as path, max(strpos(rest, '/') > 0) as is_folder from below group by 1""")
def children(spark, d):
    return catalogue.children(files(spark, d), "/home/src5")


@query(f"with {src.FILES_SQL} select doc_id, ext, stem, mtime // 86400 as day, len(string_split(path, '/')) - 2 as depth from files")
def path_parts(spark, d):
    f = files(spark, d)
    return f.select("doc_id", paths.ext_of(F.col("path")).alias("ext"), paths.stem_of(paths.file_name(F.col("path"))).alias("stem"), paths.mtime_day(F.col("mtime")).alias("day"), F.size(paths.ancestors(F.col("path"))).cast("bigint").alias("depth"))


@query(f"with {src.FILES_SQL} select path from files where not (path like '%.odt' and not regexp_matches(path, '/src7/')) and not regexp_matches(path, '/src8/')")
def ignore_rules(spark, d):
    return files(spark, d).where(~paths.ignored(F.col("path"), ["*.odt", "!src7/", "src8/"])).select("path")


# catalogue


@query(f"""with {src.FILES_SQL}, {src.STATE_SQL}
select coalesce(s.path, k.path) as path, case when k.path is null then 'new' when s.path is null then 'gone'
  when s.mtime <> k.mtime or s.size <> k.size then 'changed' else 'unchanged' end as change from seen s full join known k on s.path = k.path""")
def reconcile_changes(spark, d):
    f = files(spark, d)
    return catalogue.scan_changes(src.seen(f), src.known(f))


@query(f"with {src.FILES_SQL}, {src.STATE_SQL} select path from known where path not in (select path from seen)")
def gone_paths(spark, d):
    f = files(spark, d)
    return catalogue.unseen(src.known(f), src.seen(f)).select("path")


@query(f"with {src.FILES_SQL}, {src.STATE_SQL} select path from seen where path not in (select path from known)")
def orphans(spark, d):
    f = files(spark, d)
    return catalogue.unseen(src.seen(f), src.known(f)).select("path")


@query(f"with {src.FILES_SQL}, {src.STATE_SQL} select s.path, s.mtime, s.size from seen s left join known k on s.path = k.path where k.path is null or k.mtime <> s.mtime or k.size <> s.size")
def stale_entries(spark, d):
    f = files(spark, d)
    return catalogue.stale(src.seen(f), src.known(f)).select("path", "mtime", "size")


@query(f"""with {src.FILES_SQL}, {src.STATE_SQL},
changes as (select path, mtime, size from seen where doc_id % 3 = 0)
select path, mtime, size from known where not (path = '/home/src6/en' or (path >= '/home/src6/en/' and path < '/home/src6/en0')) and path not in (select path from changes)
union all select path, mtime, size from changes""")
def apply_changes(spark, d):
    f = files(spark, d)
    roots = spark.createDataFrame([("/home/src6/en",)], "root string")
    return catalogue.apply_changes(src.known(f), src.seen(f).where("doc_id % 3 = 0"), roots)


@query(f"""with {src.FILES_SQL}, {src.STATE_SQL}
select path, size from seen union all select path, size from known where path >= '/home/src9/' and path < '/home/src90' and path not in (select path from seen)""")
def retain_prefixes(spark, d):
    f = files(spark, d)
    offline = spark.createDataFrame([("/home/src9",)], "prefix string")
    return catalogue.retain_prefixes(src.known(f), src.seen(f), offline).select("path", "size")


@query(f"""with {src.FILES_SQL}, {src.STATE_SQL}, n as (select (select count(*) from known) as docs, (select count(*) from files) as cached)
select docs, cached, case when docs > cached + greatest(cached // 5, 10000) or (docs > 0 and cached = 0) then 'inflated'
  when cached > docs and cached - docs <= greatest(cached // 100, 1000) then 'repairable' when cached > docs then 'deflated' else 'fine' end as state from n""")
def divergence(spark, d):
    f = files(spark, d)
    return catalogue.divergence(src.known(f), f)


BATCH_SQL = f"""ready as (select path, mtime, case when ext in ('txt', 'md', 'html') then least(size, 4194304) else size end as cost from files where not ({src.NOW} - mtime >= 0 and {src.NOW} - mtime < 36000)),
ranked as (select *, row_number() over (order by cost, path) as rn, sum(cost) over (order by cost, path rows unbounded preceding) as s from ready)"""


@query(f"with {src.FILES_SQL}, {BATCH_SQL} select path, cost, rn from ranked where rn <= 200 and (rn = 1 or s <= 50000)")
def batch_fill(spark, d):
    return catalogue.batch_fill(files(spark, d), 200, 50_000, src.NOW, 36_000)


@query(f"with {src.FILES_SQL} select cast(greatest(min(360000 - ({src.NOW} - mtime)), 1) as bigint) as seconds from files where {src.NOW} - mtime >= 0 and {src.NOW} - mtime < 360000")
def soonest_retry(spark, d):
    return catalogue.soonest_retry(files(spark, d), src.NOW, 360_000)


@query(f"""with {src.FILES_SQL} select path, case when path like '/home/src1/en/%' then 'english' when path like '/home/src1/%' then 'one' when path like '/home/%' then 'home' end as owner from files""")
def source_owner(spark, d):
    sources = spark.createDataFrame([("/home", "home"), ("/home/src1", "one"), ("/home/src1/en", "english")], "prefix string, source string")
    return catalogue.owners(files(spark, d).select("path"), sources).select("path", "owner")


@query(f"""with {src.FILES_SQL}, roots as (select distinct '/home/' || source as root from files union select '/home/src1/en' union select '/data' union select '/home/src10/de/x')
select root from roots r where not exists (select 1 from roots o where starts_with(r.root, o.root || '/'))""")
def root_prune(spark, d):
    more = spark.createDataFrame([("/home/src1/en",), ("/data",), ("/home/src10/de/x",)], "root string")
    roots = files(spark, d).select(F.concat(F.lit("/home/"), "source").alias("root")).union(more).distinct()
    return catalogue.prune_roots(roots)


@query("""with ids as (select sha256(text) as identity, '/home/' || doc_id as path from documents),
r as (select *, row_number() over (partition by identity order by path) as rn, count(*) over (partition by identity) as n from ids)
select identity, min(path) as representative, array_to_string(list_sort(list(path) filter (rn between 2 and 65)), ' ') as duplicates, max(n) as n from r where n > 1 group by identity""")
def exact_dup_groups(spark, d):
    f = src.read(spark, d, "documents").select(F.sha2("text", 256).alias("identity"), F.concat(F.lit("/home/"), F.col("doc_id").cast("string")).alias("path"))
    return catalogue.duplicates(f).select("identity", "representative", F.array_join("duplicates", " ").alias("duplicates"), "n")


# types

GLOBS = ["50:text/plain:*.txt", "50:text/markdown:*.md", "50:text/html:*.html", "60:application/pdf:*.pdf", "50:application/vnd.oasis.opendocument.text:*.odt", "40:text/x-pdf-notes:*.pdf", "50:text/x-readme:README*", "50:text/x-c++src:*.C:cs", "# no glob"]


@query(f"with {src.FILES_SQL} select path, case when size = 0 then 'application/x-zerosize' else mime end as mime from files")
def mime_suffix(spark, d):
    globs = mime.parse_globs(spark.createDataFrame([(g,) for g in GLOBS], "line string"))
    return mime.by_name(files(spark, d), globs)


@query("""with recursive p(mime, parent) as (values ('text/markdown', 'text/plain'), ('text/html', 'text/plain'), ('text/plain', 'application/octet-stream'), ('application/x-ms', 'text/html')),
r as (select mime, parent as ancestor, 1 as distance from p union select r.mime, p.parent, distance + 1 from r join p on p.mime = r.ancestor where distance < 7)
select mime, ancestor, min(distance) as distance from r group by mime, ancestor""")
def mime_ancestry(spark, d):
    parents = [("text/markdown", "text/plain"), ("text/html", "text/plain"), ("text/plain", "application/octet-stream"), ("application/x-ms", "text/html")]
    return mime.ancestry(spark, spark.createDataFrame(parents, "mime string, parent string"))


# texts

DOMAIN_SQL = r"nullif(lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1), '^.*@', ''), ':\d*$', ''), '^www\.', '', 'i')), '')"


@query(f"select page_id, {DOMAIN_SQL} as domain from pages")
def domain_from_url(spark, d):
    return src.read(spark, d, "pages").select("page_id", text.domain_from_url(F.col("url")).alias("domain"))


@query(r"""select page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')), '') as title from pages""")
def html_title(spark, d):
    return src.read(spark, d, "pages").select("page_id", text.html_element(F.col("html"), "title").alias("title"))


@query(rf"""select page_id, replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?(</(script|style)\s*>|\z)', '', 'g'), '(?is)</?({text.BLOCKS})(\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&') as body from pages""")
def html_text(spark, d):
    return src.read(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("body"))


@query(r"""select doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) as n_lines,
  len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) as n_words from documents""")
def line_and_word_counts(spark, d):
    t = F.col("text")
    return src.read(spark, d, "documents").select("doc_id", F.size(text.content_lines(t)).cast("bigint").alias("n_lines"), text.word_count(t).cast("bigint").alias("n_words"))


@query(rf"select doc_id, trim(regexp_replace({text.fold_sql('text')}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) as norm from documents")
def norm_text(spark, d):
    return src.read(spark, d, "documents").select("doc_id", text.norm(F.col("text")).alias("norm"))


@query(f"""with w as (select doc_id, string_split(trim(regexp_replace({text.fold_sql("left(text, 4000)")}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' ') as w from documents),
n as (select doc_id, len(list_filter(w, lambda x: list_contains({list(text.ENGLISH)}, x))) as en, len(list_filter(w, lambda x: list_contains({list(text.IBERIAN)}, x))) as ib from w)
select doc_id, case when en >= 5 and en > ib * 2 then 'en' else 'other' end as language from n""")
def stopword_language(spark, d):
    return src.read(spark, d, "documents").select("doc_id", text.stopword_language(F.col("text")).alias("language"))


@query("select event_id, greatest(cast((event_id * 60000000 + 11644473600000000 - 1) // 1000000 - 11644473600 as bigint), 0) as unix from (select event_id - 5000 as event_id from events)")
def webkit_epoch(spark, d):
    e = src.read(spark, d, "events").withColumn("event_id", F.col("event_id") - 5000)
    return e.select("event_id", text.webkit_to_unix(F.col("event_id") * 60_000_000 + F.lit(11_644_473_600_000_000) - 1).alias("unix"))


# history


@query(f"with {src.VERSIONS_SQL} select file_id, id, saved_at, size, reason from (select *, row_number() over (partition by file_id order by saved_at desc, id desc) as rn from versions) where rn = 1")
def newest_version(spark, d):
    return history.newest(src.versions(spark, d))


@query(f"with {src.VERSIONS_SQL} select id, file_id from (select *, row_number() over (partition by file_id order by saved_at desc, id desc) as rn from versions) where rn > 3")
def all_but_three(spark, d):
    return history.all_but(src.versions(spark, d)).select("id", "file_id")


VERSION_NOW = 1_706_000_000
BUCKET_SQL = f"""case when age < 3600 then 0 when age < 86400 then 1 + age // 3600 when age < 604800 then 1000000 + age // 86400 else 2000000 + age // 604800 end"""


@query(f"with {src.VERSIONS_SQL} select id, cast({BUCKET_SQL} as bigint) as bucket from (select id, greatest({VERSION_NOW} - saved_at, 0) as age from versions)")
def time_bucket(spark, d):
    return src.versions(spark, d).select("id", history.time_bucket(F.lit(VERSION_NOW), F.col("saved_at")).alias("bucket"))


@query(f"""with recursive {src.VERSIONS_SQL},
r as (select *, row_number() over (partition by file_id order by saved_at desc, id desc) as rn, count(*) over (partition by file_id) as n, greatest({VERSION_NOW} - saved_at, 0) as age from versions),
b as (select *, cast({BUCKET_SQL} as bigint) as bucket, saved_at < {VERSION_NOW - 90 * 86400} as old from r),
fold as (
  select file_id, rn, id, [bucket] as buckets, 1 as kept_n, true as kept from b where rn = 1
  union all
  select b.file_id, b.rn, b.id, case when k then list_append(f.buckets, b.bucket) else f.buckets end, f.kept_n + k::int, k
  from (select b.*, f.buckets, f.kept_n, not b.old and (b.rn = b.n or b.reason = 'before_restore' or (f.kept_n < 10 and not list_contains(f.buckets, b.bucket))) as k
        from b join fold f on b.file_id = f.file_id and b.rn = f.rn + 1) b join fold f on b.file_id = f.file_id and b.rn = f.rn + 1)
select file_id, id, kept from fold""")
def retention(spark, d):
    return history.retention(src.versions(spark, d), VERSION_NOW).select("file_id", "id", "kept")


RANKED_SQL = f"{src.VERSIONS_SQL}, old as (select * from (select *, row_number() over (partition by file_id order by saved_at desc, id desc) as rn from versions) where rn > 1)"


@query(f"with {RANKED_SQL} select cast(coalesce(sum(size), 0) as bigint) as bytes from old")
def version_cost(spark, d):
    return history.cost(src.versions(spark, d))


@query(f"with {RANKED_SQL} select file_id, cast(sum(size) as bigint) as bytes from old group by file_id having sum(size) * 10 > 500000")
def budget_hogs(spark, d):
    return history.hogs(src.versions(spark, d), 500_000)


@query(f"with {RANKED_SQL} select id, size from (select id, size, sum(size) over (order by saved_at, id rows unbounded preceding) as s from old) where s - size < 1000000")
def evict_running(spark, d):
    return history.evict(src.versions(spark, d), 1_000_000)


@query(f"""with {src.VERSIONS_SQL}, {src.FILES_SQL}, f as (select doc_id as file_id, mtime, size from files),
v as (select file_id, saved_at, size from (select *, row_number() over (partition by file_id order by saved_at desc, id desc) as rn from versions) where rn = 1)
select f.file_id, f.mtime, f.size from f left join v using (file_id) where v.file_id is null or v.saved_at <> f.mtime or v.size <> f.size""")
def unkept_files(spark, d):
    f = files(spark, d).select(F.col("doc_id").alias("file_id"), "mtime", "size")
    return history.unkept(f, src.versions(spark, d))


@query(f"with {src.FILES_SQL} select path from files where ext in ('txt', 'md', 'odt') and size > 0 and size <= 134217728 and not starts_with(lower(name), '~$') and not starts_with(lower(name), '.~lock') and not regexp_matches(lower(name), '(~|\\.tmp|\\.bak)$')")
def history_eligible(spark, d):
    return history.eligible(files(spark, d)).select("path")


# origins

ORIGIN_SQL = f"""origins as (select doc_id, path, case when domain is null then 'unknown' else 'web_download' end as kind, case when domain is null then 1 else 3 end as confidence,
  coalesce(domain, '') as label, domain, mtime + 60 as updated_at from files join (select page_id as doc_id, {DOMAIN_SQL} as domain from pages) p using (doc_id))"""


TAKE_SQL = "o.path is null or (n.path is not null and (n.kind <> 'web_download' or o.kind = 'web_download'))"


@query(f"""with {src.FILES_SQL}, {ORIGIN_SQL},
old as (select path, case when doc_id % 3 = 0 then 'local_copy' else kind end as kind, confidence, label, updated_at from origins where doc_id % 2 = 0),
new as (select path, kind, 2 as confidence, 'new' as label, updated_at + 1 as updated_at from origins where doc_id % 5 <> 0)
select coalesce(n.path, o.path) as path, {", ".join(f"case when {TAKE_SQL} then n.{c} else o.{c} end as {c}" for c in ("kind", "confidence", "label", "updated_at"))}
from old o full join new n on o.path = n.path""")
def origin_upsert(spark, d):
    o = src.origins(spark, d)
    old = o.where("doc_id % 2 = 0").withColumn("kind", F.when(F.col("doc_id") % 3 == 0, "local_copy").otherwise(F.col("kind")))
    new = o.where("doc_id % 5 <> 0").withColumns({"confidence": F.lit(2), "label": F.lit("new"), "updated_at": F.col("updated_at") + 1})
    return origin.upsert(old, new)


@query(f"with {src.FILES_SQL}, {ORIGIN_SQL} select f.path, o.kind, o.label from files f left join origins o using (path)")
def origin_attach(spark, d):
    return origin.attach(files(spark, d).select("path"), src.origins(spark, d)).select("path", F.col("origin.kind").alias("kind"), F.col("origin.label").alias("label"))


@query(f"""with {src.FILES_SQL}, {ORIGIN_SQL}, downloads as (select path, domain, updated_at - 90 * (doc_id % 2) as finished_at from origins)
select d.path, d.domain, d.finished_at, f.mtime from downloads d join files f using (path) where f.mtime <= finished_at + 60 and domain is not null""")
def downloads_on_disk(spark, d):
    o = src.origins(spark, d)
    down = o.select("path", "domain", (F.col("updated_at") - 90 * (F.col("doc_id") % 2)).alias("finished_at"))
    return origin.latest_downloads(down, files(spark, d))


# document information

#: What stands above and below the texts that are read as papers, by doc_id modulo 4; k is the doc_id, d a day
PAPERS = (
    ("CONTRATO DE LOCAÇÃO RESIDENCIAL {k}\nLocador: Ana Braga", "Porto Alegre, {d} de abril de 2026."),
    ("Subject: Plans for week {k}\nFrom: Ann Lee <ann@example.org>\nLisbon, October {d}, 2025", "Bye"),
    ("INVOICE No {k}\nLondon, 2024-05-{dd}\nDue date: 2024-06-{dd}\nCompany name: Acme Tools {k}", "Thanks"),
    ("ATA DA REUNIÃO {k}\nPrefeitura de Vila {k}", "Aos {w} dias do mês de maio do ano de dois mil e dezoito, encerrou a sessão."),
)
DAY_WORDS = ("onze", "doze", "treze", "vinte e um", "trinta")
DAY_VALUES = (11, 12, 13, 21, 30)


def _paper(part: int):
    n = F.col("doc_id")
    day = (n % 28 + 1).cast("string")
    word = F.element_at(F.array(*(F.lit(w) for w in DAY_WORDS)), (n % 5 + 1).cast("int"))
    out = F.lit(None).cast("string")
    for k, parts in enumerate(PAPERS):
        t = F.lit(parts[part])
        for mark, value in (("{k}", n.cast("string")), ("{dd}", F.lpad(day, 2, "0")), ("{d}", day), ("{w}", word)):
            t = F.replace(t, F.lit(mark), value)
        out = F.when(n % 4 == k, t).otherwise(out)
    return out


def papers(spark, d) -> DataFrame:
    """(doc_id, ext, text): documents with the lines of a contract, a mail, a bill or minutes around them."""
    return files(spark, d, True).select("doc_id", "ext", F.concat(_paper(0), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n"), _paper(1)).alias("text"))


def _paper_sql(part: int) -> str:
    out = "case doc_id % 4"
    for k, parts in enumerate(PAPERS):
        t = "'" + parts[part].replace("\n", "' || chr(10) || '") + "'"
        for mark, value in (("{k}", "doc_id"), ("{dd}", "lpad((doc_id % 28 + 1)::varchar, 2, '0')"), ("{d}", "(doc_id % 28 + 1)"), ("{w}", f"{list(DAY_WORDS)}[doc_id % 5 + 1]")):
            t = t.replace(mark, f"' || {value} || '")
        out += f" when {k} then {t}"
    return out + " end"


PAPERS_SQL = f"papers as (select doc_id, ext, {_paper_sql(0)} || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) || {_paper_sql(1)} as text from files)"
RULES_SQL = "rules(i, lang, kind, p) as (values " + ", ".join(f"({i}, '{lang}', '{kind}', '{p}')" for i, (lang, kind, p) in enumerate(info.RULES)) + ")"
LABELS_SQL = "labels_(lang, kind, label) as (values " + ", ".join(f"('{lang}', '{k}', '{v}')" for lang, names in info.LABELS.items() for k, v in names.items()) + ")"
NORM_SQL = "trim(regexp_replace({}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


@query(f"""with {src.FILES_SQL}, {PAPERS_SQL}, {RULES_SQL}, {LABELS_SQL}, h as (select doc_id, {NORM_SQL.format(text.fold_sql("left(text, 600)"))} as head from papers),
m as (select doc_id, i, lang, kind, length(regexp_extract(head, '^(.*?)(?:' || p || ')', 1)) as place from h, rules where regexp_matches(head, p)),
best as (select doc_id, arg_min(kind, (place, i)) as kind, arg_min(lang, (place, i)) as lang from m group by doc_id)
select h.doc_id, b.kind, b.lang, label from h left join best b using (doc_id) left join labels_ l on l.lang = b.lang and l.kind = b.kind""")
def kind_rules(spark, d):
    heads = papers(spark, d).select("doc_id", info.head(F.col("text")).alias("head"))
    k = heads.select("doc_id", info.kind(F.col("head")).alias("k"))
    return k.select("doc_id", F.col("k.kind").alias("kind"), F.col("k.lang").alias("lang"), info.label(F.col("k.kind"), F.col("k.lang")).alias("label"))


INFO_SQL = f"""select doc_id, ['contrato', null, 'nota_fiscal', 'ata'][doc_id % 4 + 1] as kind,
  case doc_id % 4 when 0 then '2026-04-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') when 1 then '2025-10-' || lpad((doc_id % 28 + 1)::varchar, 2, '0')
    when 2 then '2024-05-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') else '2018-05-' || {list(DAY_VALUES)}[doc_id % 5 + 1] end as date,
  case doc_id % 4 when 0 then 'Ana Braga' when 1 then 'Ann Lee' when 2 then 'Acme Tools ' || doc_id else 'Prefeitura de Vila ' || doc_id end as entity,
  case doc_id % 4 when 0 then 'CONTRATO DE LOCAÇÃO RESIDENCIAL ' || doc_id when 1 then 'Plans for week ' || doc_id when 2 then 'INVOICE No ' || doc_id else 'ATA DA REUNIÃO ' || doc_id end as title,
  case doc_id % 4 when 0 then '2026-04-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') || ' Contrato de locação residencial ' || doc_id when 1 then '2025-10-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') || ' Plans for week ' || doc_id
    when 2 then '2024-05-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') || ' INVOICE No ' || doc_id else '2018-05-' || {list(DAY_VALUES)}[doc_id % 5 + 1] || ' Ata da reunião ' || doc_id end || '.' || ext as suggested_name from files"""


@query(f"with {src.FILES_SQL} {INFO_SQL}")
def document_info(spark, d):
    """What is read from the whole texts between lines that say whose and of what day they are."""
    asked = ("kind", "date", "entity", "title", "suggested_name")
    return analyze(papers(spark, d), asked).select("doc_id", *asked)


@query()
def highlights(spark, d):
    return analyze(src.read(spark, d, "documents").select("doc_id", "text"), ("highlights",)).select("doc_id", "highlights")


@query()
def document_dates(spark, d):
    return papers(spark, d).select("doc_id", F.array_join(info.dates(F.col("text")), " ").alias("dates"))


@query(r"""with t as (select doc_id, text || ' on 20' || lpad((doc_id % 40)::varchar, 2, '0') || '-' || lpad((doc_id % 14)::varchar, 2, '0') || '-' || lpad((doc_id % 33)::varchar, 2, '0') || '.' as text from documents),
c as (select doc_id, unnest(regexp_extract_all(text, '\b(\d{4})-(\d{2})-(\d{2})\b')) as d from t) select doc_id, d from c where try_cast(d as date) is not null""")
def iso_dates(spark, d):
    """Texts with a date of their number at the end, which exists or not."""
    two = lambda n: F.lpad((F.col("doc_id") % n).cast("string"), 2, "0")
    t = F.concat("text", F.lit(" on 20"), two(40), F.lit("-"), two(14), F.lit("-"), two(33), F.lit("."))
    p = src.read(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(t, F.lit(info._ISO), F.lit(0))).alias("d"))
    return p.where(info.calendar(F.substring("d", 1, 4), F.substring("d", 6, 2), F.substring("d", 9, 2)).isNotNull())


@query()
def suggested_names(spark, d):
    t = F.col("text")
    docs = papers(spark, d).select("doc_id", "ext", info.head(t).alias("head"), F.get(text.content_lines(t), F.lit(0)).alias("title"), F.get(info.dates(t), F.lit(0)).alias("date"))
    docs = docs.withColumn("k", info.kind(F.col("head"))).withColumn("kind", info.label(F.col("k.kind"), F.col("k.lang")))
    return docs.select("doc_id", info.suggested_name(F.col("date"), F.col("kind"), F.left("title", F.lit(200)), F.col("ext")).alias("name"))


# sentences are parted without lookaround: a mark is put where one ends, twice, as ends may share a character
_WRAP = "regexp_replace({}, '([^.!?:;])\\n(\\p{{Ll}})', '\\1 \\2', 'g')"
_PART = "regexp_replace({}, '([.!?])\\s+([0-9A-ZÀ-Ý\"“(])', '\\1' || chr(1) || '\\2', 'g')"
TFIDF_SQL = f"""pieces as (select doc_id, string_split_regex({_PART.format(_PART.format(_WRAP.format(_WRAP.format("text"))))}, '[\\n\\x01]') as ps from documents where text is not null),
good as (select doc_id, list_filter(ps, lambda s: len(list_filter(string_split_regex(s, '\\s+'), lambda x: x <> '')) >= 6 and length(regexp_replace(s, '\\P{{L}}+', '', 'g')) > 0
  and 2 * length(regexp_replace(s, '\\P{{Lu}}+', '', 'g')) < length(regexp_replace(s, '\\P{{L}}+', '', 'g'))) as ss from pieces),
sent as (select doc_id, unnest(ss) as s, generate_subscripts(ss, 1) - 1 as sentence from good),
n as (select doc_id, count(*) as n from sent group by doc_id),
words as (select doc_id, sentence, unnest(string_split({NORM_SQL.format(text.fold_sql("s"))}, ' ')) as term from sent),
t as (select doc_id, sentence, term, count(*) as c from words where length(term) >= 2 group by all),
df as (select doc_id, term, count(*) as df from t group by all),
raw as (select doc_id, sentence, term, (1 + ln(c)) * (ln((1 + n) / (1 + df)) + 1) as w from t join df using (doc_id, term) join n using (doc_id)),
len as (select doc_id, sentence, sqrt(sum(w * w)) as l from raw group by all),
weights as (select doc_id, sentence, term, w / l / (1 + 1e-9) as weight from raw join len using (doc_id, sentence))"""


@query(f"with {TFIDF_SQL} select doc_id, sentence, term, round(weight, 6) as weight from weights")
def tfidf_terms(spark, d):
    return rounded(info.tfidf(src.read(spark, d, "documents")), "weight")


@query(f"""with {TFIDF_SQL}, centre as (select doc_id, term, sum(weight) as m from weights group by all), size as (select doc_id, sqrt(sum(m * m)) as size from centre group by all)
select doc_id, sentence, round(sum(weight * m / size), 6) as rel from weights join centre using (doc_id, term) join size using (doc_id) group by all""")
def sentence_relevance(spark, d):
    return rounded(info.relevance(src.read(spark, d, "documents")), "rel")


# streams


@query("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from e)
select user_id, floor(epoch(min(ts)))::bigint as start, floor(epoch(max(ts) + interval 30 minute))::bigint as "end", count(*) as n from s group by user_id, k""")
def session_debounce(spark, d):
    s = reconcile.sessions(src.read(spark, d, "events"), gap="30 minutes")
    return s.select("user_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "n")


@query("select distinct epoch(time_bucket(interval 1 hour, ts))::bigint as start, user_id from events")
def coalesce_bursts(spark, d):
    b = reconcile.coalesce_bursts(src.read(spark, d, "events"), "1 hour", "user_id")
    return b.select(F.unix_timestamp("start").alias("start"), "user_id")


@query(f"with {src.FILES_SQL} select path from files where doc_id % 7 = 0 or (mtime - (doc_id % 5) * 20000) // 86400 <> mtime // 86400")
def name_doc_stale(spark, d):
    f = files(spark, d)
    old = f.where("doc_id % 7 <> 0").withColumn("mtime", F.col("mtime") - (F.col("doc_id") % 5) * 20_000)
    return reconcile.name_doc_stale(old, f)


from . import work_queries  # noqa: E402,F401  they register themselves


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return content_and_bm25(spark, d)
