"""A search request and the plan that answers it."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import catalogue, origin, search
from ..operators.index import Index


@dataclass(frozen=True)
class Filter:
    under: str | None = None
    ext: tuple[str, ...] | None = None
    mime: tuple[str, ...] | None = None
    mtime: tuple[int, int] | None = None
    size: tuple[int, int] | None = None
    kind: str | None = None

    def column(self):
        return catalogue.filters(self.under, self.ext, self.mime, self.mtime, self.size, self.kind)


@dataclass(frozen=True)
class Page:
    offset: int = 0
    limit: int = 50


@dataclass(frozen=True)
class Request:
    q: str = ""
    mode: str = "name"
    filter: Filter = field(default_factory=Filter)
    page: Page = field(default_factory=Page)
    include_origin: bool = False


MODES = ("name", "content", "both", "list", "largest")


@dataclass(frozen=True)
class Tables:
    """files(path, name, stem, ext, mime, source, mtime, size) and the index tables; origins and sources may be missing.

    sources(prefix, source, retained, available): a file of a source that can't be reached is shown only if it is
    retained. name_stats, content_stats: one row (n, avgdl), where an index keeps them.
    """

    files: DataFrame
    postings: DataFrame
    lengths: DataFrame
    vocab: DataFrame
    grams: DataFrame | None = None
    origins: DataFrame | None = None
    sources: DataFrame | None = None
    name_stats: DataFrame | None = None
    content_stats: DataFrame | None = None

    @classmethod
    def of(cls, index: Index, origins: DataFrame | None = None, sources: DataFrame | None = None) -> Tables:
        return cls(index.files, index.postings, index.lengths, index.vocab, index.grams, origins, sources, index.stats_of("name"), index.stats_of("content"))


def read_plan(mode: str, filter: Filter, page: Page) -> tuple[bool, int]:
    """(paged, fetch): whether the ranked hits may be cut early, and how many of them are read at most."""
    stat = filter.mtime is not None or filter.size is not None
    typed = any(x is not None for x in (filter.under, filter.ext, filter.mime, filter.kind))
    paged = mode not in ("list", "largest", "both") and not stat and not (mode == "content" and typed)
    return paged, min(page.offset + 2 * page.limit, search.CEILING) if paged else search.CEILING


def matched(tables: Tables, request: Request) -> DataFrame:
    """What a request matches, before order and page: path, score, match_kind and what orders them.

    Hits have each path once. Listings take files as they are, which an index holds once each.

    Filters apply before ranking, so a page is as full as the matches allow. An unknown mode searches names. Queries
    are cut at 256 characters and composed; content is asked for by the terms of a body.
    """
    q = unicodedata.normalize("NFKC", request.q[:256])
    spark = tables.files.sparkSession
    mode = request.mode if request.mode in MODES else "name"
    files = tables.files.where(request.filter.column())
    if mode in ("list", "largest"):
        order = F.col("mtime" if mode == "list" else "size").cast("double")
        return files.select("path", F.lit(0.0).alias("score"), F.lit("name").alias("match_kind"), order.alias("o1"), F.lit(0.0).alias("o2"), F.lit(0.0).alias("o3"), F.lit(0).alias("tie"))
    names = content = None
    if mode in ("name", "both"):
        names = search.search_names(files, search.query_words(spark, q), None, tables.grams, tables.name_stats).dropDuplicates(["path"])
    if mode in ("content", "both"):
        terms = search.query_terms(tables.vocab, search.content_words(spark, q))
        rows = search.search_content(tables.postings, tables.lengths, terms, limit=None, stats=tables.content_stats)
        content = rows.join(files.select("path"), "path", "left_semi")
    match = F.when(F.col("whole"), 1e6).otherwise(0.0) + F.col("quality")
    if mode == "name":
        return names.select("path", "score", F.lit("name").alias("match_kind"), match.alias("o1"), F.col("score").alias("o2"), F.lit(0.0).alias("o3"), paths.mtime_day(F.col("mtime")).alias("tie"))
    if mode == "content":
        return content.select("path", "score", F.lit("body").alias("match_kind"), F.col("score").alias("o1"), F.lit(0.0).alias("o2"), F.lit(0.0).alias("o3"), F.lit(0).alias("tie"))
    merged = search.merged(names, content)
    match = F.when(F.col("match").isNull(), -1.0).otherwise(F.when(F.col("match.whole"), 1e6).otherwise(0.0) + F.col("match.quality"))
    low = F.lit(-1.0)
    return merged.select("path", "score", "match_kind", (match - F.col("tier") * 1e9).alias("o1"), F.coalesce("name_score", low).alias("o2"), F.coalesce("body_score", low).alias("o3"), F.lit(0).alias("tie"))


def answer(tables: Tables, request: Request) -> DataFrame:
    """Hits of one page: path, name, score, match_kind, size, mtime, ext, mime, source, available (and origin).

    A hit of a source that is away is dropped unless the source is retained; the page isn't filled up for it.
    """
    order = [F.desc(c) for c in ("o1", "o2", "o3", "tie")]
    page = request.page
    ranked = matched(tables, request).orderBy(*order, "path").limit(min(page.offset + page.limit, search.CEILING) if request.mode not in ("list", "largest") else page.offset + page.limit)
    hits = ranked.orderBy(*order, "path").offset(page.offset).limit(page.limit)
    # a page of hits is what is broadcast and made distinct, not the files
    rows = tables.files.select("path", "name", "size", "mtime", "ext", "mime", "source").join(F.broadcast(hits) if page.limit <= search.CEILING else hits, "path").dropDuplicates(["path"])
    rows = with_available(rows, tables.sources)
    if request.include_origin and tables.origins is not None:
        rows = origin.attach(rows, tables.origins)
    extra = ["origin"] if "origin" in rows.columns else []
    return rows.orderBy(*order, "path").select("path", "name", "score", "match_kind", "size", "mtime", "ext", "mime", "source", "available", *extra)


def with_available(rows: DataFrame, sources: DataFrame | None) -> DataFrame:
    """rows(path, ...) with available, without those of sources that are away and not retained.

    sources(prefix, retained, available): a path belongs to the longest prefix; one without a source is available.
    """
    if sources is None:
        return rows.withColumn("available", F.lit(True))
    state = sources.select("prefix", F.struct("available", "retained").alias("source"))
    owned = catalogue.owners(rows.select("path"), state).select("path", "owner")
    out = rows.join(owned, "path", "left").withColumn("available", F.coalesce("owner.available", F.lit(True)))
    return out.where(F.col("available") | F.coalesce("owner.retained", F.lit(False))).drop("owner")


def totals(tables: Tables, request: Request) -> DataFrame:
    """(total, next_offset): matches, counted up to the ceiling but for listings, and where the next page begins, if any."""
    found = matched(tables, request).select("path")
    found = found if request.mode in ("list", "largest") else found.limit(search.CEILING)
    after = request.page.offset + request.page.limit
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return total.withColumn("next_offset", F.when(F.lit(after) < F.col("total"), F.lit(after).cast("bigint")))
