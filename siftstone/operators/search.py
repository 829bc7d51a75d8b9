"""Search by name (n-grams), by content (ranked terms) and by both, and the index tables behind it.

Index tables are DataFrames: name_grams(gram, path), postings(term, path, tf), doc_len(path, dl), vocab(term, df). A
query reads the posting lists of its own grams or terms only, so a table sorted by them is pruned to a few row groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text

K1, B = 1.2, 0.75
#: Ranking constants of name search, and the weight of the word as typed (fixed values)
WORD_EDGE, WHOLE_NAME, EXACT = 1000.0, 100_000.0, 2.0
#: Limits of prefix expansion (fixed values)
MIN_PREFIX, MAX_TERMS, DOC_BUDGET = 3, 32, 50_000
CEILING = 5000


def name_grams(files: DataFrame) -> DataFrame:
    """(gram, path, dl): the grams of each name and how many it has."""
    # the name's text is bound to a variable: slices are taken from its value, not from its expression over and over
    grams = F.transform(F.array(text.name_text(text.name_words(F.col("name")))), text.name_grams)[0]
    return files.select("path", grams.alias("grams")).select(F.explode("grams").alias("gram"), "path", F.size("grams").alias("dl"))


def terms_of(content: DataFrame, spaced: bool = False) -> DataFrame:
    """(path, terms) of content(path, text). spaced: no text of a script without spaces is to be expected."""
    return content.select("path", (text.spaced_terms(F.col("text")) if spaced else text.terms(F.col("text"))).alias("terms"))


def postings(content: DataFrame, spaced: bool = False) -> DataFrame:
    """(term, path, tf) of content(path, text). spaced: no text of a script without spaces is to be expected."""
    return terms_of(content, spaced).select("path", F.explode("terms").alias("term")).groupBy("term", "path").agg(F.count(F.lit(1)).alias("tf"))


def doc_len(postings: DataFrame) -> DataFrame:
    return postings.groupBy("path").agg(F.sum("tf").alias("dl"))


def vocab(postings: DataFrame) -> DataFrame:
    """(term, df). A term and a path meet once in postings, so counting rows counts documents."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


# names


def is_unspaced(word: str) -> bool:
    ranges = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF))
    return any(a <= ord(c) <= b for c in word for a, b in ranges)


def whole_word(word: str) -> bool:
    """One or two letters of a spaced script stand for exactly that word."""
    return len(word) <= 2 and not is_unspaced(word)


@dataclass(frozen=True)
class NamePlan:
    words: tuple[str, ...]
    must: tuple[str, ...]
    edges: tuple[str, ...]


def plan_name(words: list[str]) -> NamePlan:
    """Grams that a name must have, and the word edges that lift it, for folded query words."""
    must: set[str] = set()
    edges = []
    for w in words:
        if whole_word(w):
            must |= {f" {w} "} if len(w) == 1 else {f" {w}", f"{w} "}
            continue
        must |= {w} if len(w) < 3 else {w[i : i + 3] for i in range(len(w) - 2)}
        if len(w) >= 2:
            edges += [f" {w[:2]}", f"{w[-2:]} "]
    return NamePlan(tuple(words), tuple(sorted(must)), tuple(edges))


def query_words(spark, q: str) -> list[str]:
    """Folded words of a query, by the functions that index names; the query is cut at 256 characters."""
    return spark.range(1).select(text.name_words(F.lit(q[:256])).alias("w")).first()["w"]


def content_words(spark, q: str) -> list[str]:
    """Terms of a query as a body's: bigrams of unspaced scripts, no Arabic articles."""
    return list(dict.fromkeys(spark.range(1).select(text.terms(F.lit(q[:256]), index=False).alias("w")).first()["w"]))


def quality(words: tuple[str, ...]) -> Column:
    """Sum over query words of 3 for a word of the name, 2 for the start of one, 1 for a part of the name; null if one isn't met.

    Reads the columns words and ntext. Words of one or two letters have to be whole.
    """
    total = F.lit(0)
    for w in words:
        part = F.when(F.array_contains("words", w), 3)
        if not whole_word(w):
            part = part.when(F.exists("words", lambda x: x.startswith(w)), 2).when(F.contains(F.col("ntext"), F.lit(w)), 1)
        total = total + part
    return total


def search_names(files: DataFrame, words: list[str], limit: int | None = 50, grams: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """files that have all words in their names, best first: (files..., whole, quality, score).

    Candidates come from the gram table by intersecting posting lists, counted before anything else is read; every
    candidate is then judged, so no ceiling cuts the result. Order: whole name, quality, score, day, path. stats: one
    row (n, avgdl) of the gram table, where an index keeps it.
    """
    plan = plan_name(words)
    if not plan.must:
        return files.select("*", F.lit(None).cast("boolean").alias("whole"), F.lit(None).cast("int").alias("quality"), F.lit(None).cast("double").alias("score")).limit(0)
    grams = name_grams(files) if grams is None else grams
    # a path has dl rows, so their inverses add up to the number of paths; nothing is grouped by path for it
    if stats is None:
        stats = grams.agg(F.round(F.sum(1 / F.col("dl"))).alias("n"), F.count(F.lit(1)).alias("rows")).select("n", (F.col("rows") / F.col("n")).alias("avgdl"))
    hit = grams.where(F.col("gram").isin(*plan.must))
    df = hit.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    scored = hit.join(F.broadcast(df), "gram").crossJoin(F.broadcast(stats))  # df has a row for each gram of the query, stats one
    found = scored.groupBy("path").agg(F.count(F.lit(1)).alias("k"), F.sum(bm25(F.lit(1.0), F.col("dl"), F.col("df"), F.col("n"), F.col("avgdl"))).alias("base"))
    found = found.where(F.col("k") == len(plan.must)).select("path", "base")
    judged = files.join(found, "path").withColumn("words", text.name_words(F.col("name")))
    judged = judged.withColumn("ntext", text.name_text(F.col("words"))).withColumn("swords", text.name_words(F.col("stem")))
    own = F.col("base")
    for e in plan.edges:
        own = own + F.when(F.contains(F.col("ntext"), F.lit(e)), WORD_EDGE).otherwise(0.0)
    whole = F.array_join("swords", " ") == " ".join(words)
    judged = judged.withColumns({"whole": whole, "quality": quality(plan.words), "score": own + F.when(whole, WHOLE_NAME).otherwise(0.0)})
    out = judged.where("quality is not null").drop("words", "ntext", "swords", "base")
    if limit is None:
        return out
    return out.orderBy(F.desc("whole"), F.desc("quality"), F.desc("score"), F.desc(paths.mtime_day(F.col("mtime"))), "path").limit(limit)


# content

# fixed values: plural endings and what they become, and the other way
TO_SINGULAR = (("oes", ("ao",)), ("aes", ("ao",)), ("aos", ("ao",)), ("ais", ("al",)), ("eis", ("el", "il")), ("ois", ("ol",)), ("uis", ("ul",)), ("ns", ("m",)), ("res", ("r",)), ("zes", ("z",)), ("ses", ("s",)), ("xes", ("x",)), ("ches", ("ch",)), ("shes", ("sh",)), ("s", ("",)))
TO_PLURAL = (("ao", ("oes", "aes", "aos")), ("al", ("ais",)), ("el", ("eis",)), ("il", ("eis",)), ("ol", ("ois",)), ("ul", ("uis",)), ("m", ("ns",)), ("r", ("res",)), ("z", ("zes",)), ("s", ("ses",)), ("x", ("xes",)), ("ch", ("ches",)), ("sh", ("shes",)), ("", ("s",)))
# fixed values: endings of Russian and Ukrainian nouns, adjectives and participles
SLAVIC = tuple(
    "а я о е ы и у ю ь і ї є ом ем ой ей ою ею ам ям ах ях ов ев ів їв ий ій ия ие ии ию ью ья ье ьи ый ая яя ое ее ые ым им ім ую юю ых их іх ої ові еві ами ями ого его ього ому ему ьому ыми ими іми ием иям иях ьям ьях ьев иями ьями".split()
)


def inflections(word: str) -> list[str]:
    """Plural and singular forms of an ASCII word of four letters or more, in rule order."""
    if not word.isascii() or len(word) < 4:
        return []
    made = (word[: len(word) - len(end)] + new for end, news in TO_SINGULAR + TO_PLURAL if word.endswith(end) and len(word) - len(end) >= 2 for new in news)
    return list(dict.fromkeys(w for w in made if len(w) >= 4))


def slavic_stem(word: str) -> str | None:
    """The word without its longest ending that leaves four letters; the word itself if it has four."""
    if not word or any(not ("а" <= c <= "я" or c in "іїєґ") for c in word):
        return None
    stems = [word[: -len(e)] for e in SLAVIC if word.endswith(e) and len(word) - len(e) >= 4]
    stem = min(stems, key=len, default=word)
    return stem if len(stem) >= 4 else None


def beginning(vocab: DataFrame, prefix: str, rest: tuple[str, ...] | None = None) -> DataFrame:
    """(term, df): words that begin with prefix, the most frequent first, until MAX_TERMS or DOC_BUDGET is reached.

    The first always counts. rest: only words that go on with one of these or not at all.
    """
    some = vocab.where((F.col("term") >= prefix) & F.col("term").startswith(prefix))
    if rest is not None:
        some = some.where(F.substring("term", len(prefix) + 1, 99).isin("", *rest))
    top = some.orderBy(F.desc("df"), "term").limit(MAX_TERMS)
    order = Window.orderBy(F.desc("df"), "term")  # over MAX_TERMS rows at most
    ranked = top.withColumns({"rn": F.row_number().over(order), "sum": F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return ranked.where((F.col("rn") == 1) | (F.col("sum") <= DOC_BUDGET)).select("term", "df")


def query_terms(vocab: DataFrame, words: list[str], complete: bool = False) -> list[tuple[int, str, float]]:
    """(word number, term, boost) of each query word's forms that the index holds. A few dozen rows, by design.

    The word itself weighs EXACT if it has other forms. The last word also stands for what it begins, unless complete.
    """
    out = []
    for k, w in enumerate(words):
        forms = [] if is_unspaced(w) else inflections(w)
        held = [r["term"] for r in vocab.where(F.col("term").isin(*forms)).select("term").collect()] if forms else []
        if not is_unspaced(w):
            if stem := slavic_stem(w):
                held += [r["term"] for r in beginning(vocab, stem, SLAVIC).collect()]
            if k == len(words) - 1 and len(w) >= MIN_PREFIX and not complete:
                held += [r["term"] for r in beginning(vocab, w).collect()]
                # an article still too short to be cut from the word as typed
                article = next((a for a in text.ARTICLES if w.startswith(a) and len(w) - len(a) >= 2), None)
                if article:
                    held += [r["term"] for r in beginning(vocab, w[len(article) :]).collect()]
        others = sorted(set(held) - {w})
        out += [(k, w, EXACT if others else 1.0), *((k, t, 1.0) for t in others)]
    return out


def search_content(postings: DataFrame, lengths: DataFrame, terms: list[tuple[int, str, float]], tf: bool = True, limit: int | None = 50, stats: DataFrame | None = None) -> DataFrame:
    """(path, score) of documents that have a form of every word, by the sum of their forms' scores.

    tf False is the basic index: occurrences don't count. lengths: doc_len of the postings; it isn't read where the
    postings have dl of their own and stats, one row (n, avgdl), is given.
    """
    spark = postings.sparkSession
    n_words = len({k for k, _, _ in terms})
    if not n_words:
        return lengths.select("path", F.lit(0.0).alias("score")).limit(0)
    wanted = F.broadcast(spark.createDataFrame(terms, "word int, term string, boost double"))  # the forms of one query
    if stats is None:
        stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    hit = postings.where(F.col("term").isin(*sorted({t for _, t, _ in terms})))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = hit.join(F.broadcast(df), "term").join(wanted, "term").crossJoin(F.broadcast(stats))
    rows = rows if "dl" in postings.columns else rows.join(lengths, "path")
    times = F.col("tf").cast("double") if tf else F.lit(1.0)
    each = F.col("boost") * bm25(times, F.col("dl"), F.col("df"), F.col("n"), F.col("avgdl"))
    out = rows.groupBy("path").agg(F.countDistinct("word").alias("k"), F.sum(each).alias("score")).where(F.col("k") == n_words).select("path", "score")
    return out if limit is None else out.orderBy(F.desc("score"), "path").limit(limit)


# both


def merged(names: DataFrame, content: DataFrame) -> DataFrame:
    """One row for each path of names(path, whole, quality, score) and content(path, score): match, both scores, match_kind, tier."""
    n = names.select("path", F.struct("whole", "quality").alias("match"), F.col("score").alias("name_score"))
    c = content.select("path", F.col("score").alias("body_score"))
    out = n.join(c, "path", "full_outer")
    named, said = F.col("name_score").isNotNull(), F.col("body_score").isNotNull()
    return out.withColumns({"match_kind": F.when(named & said, "both").when(named, "name").otherwise("body"), "score": F.coalesce("name_score", "body_score"), "tier": F.when(named & said, 0).when(named, 1).otherwise(2)})


def search_both(names: DataFrame, content: DataFrame, limit: int = 50) -> DataFrame:
    """merged() in bands.

    Both before name before body; within a band by name match, name score, body score, path. Scores are never mixed.
    """
    out = merged(names, content)
    return out.orderBy("tier", F.desc_nulls_last("match"), F.desc_nulls_last("name_score"), F.desc_nulls_last("body_score"), "path").limit(limit).select("path", "match_kind", "score", "tier")


def capped_count(rows: DataFrame, cap: int = CEILING) -> DataFrame:
    """(n): how many rows there are, up to cap; stops reading there."""
    return rows.limit(cap).agg(F.count(F.lit(1)).alias("n"))
