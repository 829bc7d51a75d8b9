import pytest
from pyspark.sql import functions as F

from siftstone.functions import text
from siftstone.operators import index, search
from siftstone.plans.request import Filter, Page, Request, Tables, answer, read_plan, totals


def files(spark, rows):
    rows = [(p, p.rsplit("/", 1)[-1], m) for p, m in rows]
    df = spark.createDataFrame(rows, "path string, name string, mtime bigint")
    stem = F.regexp_replace("name", r"(?<=.)\.[^.]+$", "")
    return df.withColumns({"stem": stem, "size": F.lit(1).cast("bigint")})


def ranked(spark, names, q):
    f = files(spark, [(n if "/" in n else f"/h/{n}", 86400 * k) for k, n in enumerate(names)])
    return [r["name"] for r in search.search_names(f, search.query_words(spark, q)).collect()]


@pytest.mark.parametrize(
    "names,q,want",
    [
        # a word of two letters or one stands for itself alone
        (["Bill TV.ods", "Tvedt.ods", "latvia.md", "TV.ods"], "tv", ["TV.ods", "Bill TV.ods"]),
        (["k.csv", "kiwi.csv", "Plan-K-7.csv"], "K", ["k.csv", "Plan-K-7.csv"]),
        # the whole name, a word, the beginning of a word, the inside of one
        (
            ["subgardening.md", "old-gardens-north.md", "my garden in may.md", "garden z.rst", "garden.text"],
            "garden",
            ["garden.text", "garden z.rst", "my garden in may.md", "old-gardens-north.md", "subgardening.md"],
        ),
        # grams of the word in one name, but not in a row
        (["wx_11.md", "yz_22.md"], "wxyz", []),
        # every word, in any order
        (["Trip Oslo Hansen (2).jpg", "Oslo notes.md"], "hansen oslo", ["Trip Oslo Hansen (2).jpg"]),
        (["年度计划草案7.md", "旅行の写真集.md"], "写", ["旅行の写真集.md"]),
        (["Größe Tabelle.md", "Čapek.md"], "grosse", ["Größe Tabelle.md"]),
    ],
)
def test_names(spark, names, q, want):
    assert ranked(spark, names, q) == want


def test_newer_first_on_ties(spark):
    f = files(spark, [("/x/7.gif", 86400 * 2), ("/y/7.gif", 86400 * 500), ("/z/7.gif", 86400 * 40)])
    assert [r["path"] for r in search.search_names(f, ["7"]).collect()] == ["/y/7.gif", "/z/7.gif", "/x/7.gif"]


@pytest.mark.parametrize("a,b", [("ÃÊÍ ñõ", "aei no"), ("Đorđe Ærø", "dorde aero"), ("Maß", "mass"), ("Мёд", "мед"), ("Épée", "epee"), ("λόγος", "λογοσ")])
def test_fold(spark, a, b):
    assert spark.range(1).select(text.fold(F.lit(a))).first()[0] == b


def test_composed_forms(spark):
    """Jamo, marks of kana, half- and full-width forms, as NFKC has them; other texts aren't handed over."""
    forms = {"\u1112\u1161\u11ab": "한", "か\u3099": "が", "ｶﾞ": "ガ", "Ｔｅｘｔ": "Text", "plain é": "plain é", None: None}
    df = spark.createDataFrame([(k, v) for k, v in forms.items()], "a string, b string")
    assert df.select(text.compose(F.col("a")).alias("a"), "b").where("not a <=> b").collect() == []


def test_tokens_of_unspaced_text(spark):
    one = lambda t, index: spark.range(1).select(text.terms(F.lit(t), index)).first()[0]
    assert one("天气预报 ok", False) == ["天气", "气预", "预报", "ok"]
    assert sorted(one("天气预报 ok", True)) == sorted(["天气", "气预", "预报", "天", "气", "预", "报", "ok"])
    assert one("spaced " + "w" * 40 + " क्या", True) == ["spaced", "क्या"]
    assert spark.range(1).select(F.size(text.name_grams(F.lit(" 天气 q")))).first()[0] == 9


def body(spark, rows):
    p = search.postings(spark.createDataFrame(rows, "path string, text string"))
    return p, search.doc_len(p), search.vocab(p)


def content(spark, rows, q):
    p, n, v = body(spark, rows)
    return [r["path"] for r in search.search_content(p, n, search.query_terms(v, search.content_words(spark, q))).collect()]


def test_content_forms(spark):
    rows = [("many", "nos quintais das casas"), ("one", "um quintal da aldeia"), ("none", "quinta feira")]
    assert content(spark, rows, "quintal") == ["one", "many"]
    assert content(spark, rows, "casa") == ["many"]
    assert content(spark, rows, "nos quin") == ["many"]
    assert content(spark, rows, "qu") == []
    assert content(spark, rows, "quin casas") == []


def test_content_scripts(spark):
    rows = [("a", "明天的天气预报说有雨。"), ("b", "天气很好"), ("c", "المدينة الكبيرة"), ("d", "новая книга"), ("e", "страницы книги")]
    assert sorted(content(spark, rows, "天气")) == ["a", "b"]
    assert content(spark, rows, "气预报") == ["a"]
    assert content(spark, rows, "雨") == ["a"]
    assert sorted(content(spark, rows, "книгами")) == ["d", "e"]
    assert content(spark, rows, "مدينة الكب") == ["c"]


def test_inflections():
    assert search.inflections("licoes")[:1] == ["licao"]
    assert search.inflections("sol") == []
    assert search.slavic_stem("журналами") == "журнал"
    assert search.slavic_stem("поле") == "поле"
    assert search.slavic_stem("xyz") is None


def test_index_and_requests(spark, tmp_path):
    rows = [("/h/a/Red Boat.md", 900, "the boats of 天气预报"), ("/h/b/boat.txt", 86400 * 3, "a boat"), ("/h/b/other.txt", 5, "no such thing"), ("/x/boating.md", 7, "boating the boat")]
    f = files(spark, [(p, m) for p, m, _ in rows]).join(spark.createDataFrame(rows, "path string, m long, text string").select("path", "text"), "path")
    f = f.withColumns({"ext": F.regexp_extract("name", r"([^.]+)$", 1), "mime": F.lit("text/plain"), "source": F.lit("s")})
    i = index.build(f, str(tmp_path / "i"))
    assert index.build(f.limit(0), str(tmp_path / "i")).files.count() == 4
    ask = lambda *a, t=Tables.of(i), **k: [r["path"] for r in answer(t, Request(*a, **k)).collect()]
    assert ask("boat") == ["/h/b/boat.txt", "/h/a/Red Boat.md", "/x/boating.md"]
    assert ask("气预报", "content") == ["/h/a/Red Boat.md"]
    assert ask("boat", "content", Filter(under="/h")) == ["/h/b/boat.txt", "/h/a/Red Boat.md"]
    assert ask("boat", "both")[:2] == ["/h/b/boat.txt", "/h/a/Red Boat.md"]
    assert ask("", "list", page=Page(0, 1)) == ["/h/b/boat.txt"] and ask("x" * 300) == []
    got = totals(Tables.of(i), Request("boat", page=Page(0, 2))).first()
    assert (got["total"], got["next_offset"]) == (3, 2)
    assert totals(Tables.of(i), Request("boat", page=Page(2, 2))).first()["next_offset"] is None
    assert [read_plan(m, x, Page(10, 5)) for m, x in (("name", Filter()), ("content", Filter(ext=("a",))), ("name", Filter(size=(0, 1))), ("both", Filter()))] == [(True, 20), (False, 5000), (False, 5000), (False, 5000)]
    # an index that is brought up to date equals one that is built anew
    new = f.where("path <> '/x/boating.md'").withColumn("text", F.when(F.col("path") == "/h/b/other.txt", "a new boat").otherwise(F.col("text")))
    up = index.upsert(i, new.where("path = '/h/b/other.txt'"), spark.createDataFrame([("/x/boating.md",)], "path string"), str(tmp_path / "j"))
    anew = index.build(new, str(tmp_path / "k"))
    for t in index.TABLES:
        assert sorted(map(str, getattr(up, t).select(getattr(anew, t).columns).collect())) == sorted(map(str, getattr(anew, t).collect())), t
    assert [r["path"] for r in index.unreferenced(i, new).collect()] == ["/x/boating.md"]
    assert index.unreferenced(i, new.limit(0)).collect() == []
    packed = index.compact(up, str(tmp_path / "l"))
    for t in index.TABLES:
        assert sorted(map(str, getattr(packed, t).select(getattr(anew, t).columns).collect())) == sorted(map(str, getattr(anew, t).collect())), t
    assert [r["path"] for r in index.missing(up, f).collect()] == ["/x/boating.md"]
    plan = i.postings.where(F.col("term").isin("boat", "the"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [boat,the])]" in plan


def test_both_bands(spark):
    n = spark.createDataFrame([("/b", False, 3, 2.0), ("/n", True, 3, 1.0)], "path string, whole boolean, quality int, score double")
    c = spark.createDataFrame([("/b", 0.5), ("/c", 9.0), ("/a", 9.0)], "path string, score double")
    got = [(r["path"], r["match_kind"], r["score"]) for r in search.search_both(n, c).collect()]
    assert got == [("/b", "both", 2.0), ("/n", "name", 1.0), ("/a", "body", 9.0), ("/c", "body", 9.0)]


def test_index_in_parts(spark, tmp_path, monkeypatch):
    """A query writes the parts that it reads, and each part equals that of a whole index; rows of one path are one document."""
    rows = [("/a/Red Boat.md", "the boats of 天气预报"), ("/a/boat.txt", "a boat"), ("/a/boat.txt", "a boat of المدينة"), ("/a/none.txt", None), ("/a/signs.txt", "?!")]
    f = files(spark, [(p, k) for k, (p, _) in enumerate(rows)]).withColumn("text", F.element_at(F.array(*(F.lit(t) for _, t in rows)), (F.col("mtime") + 1).cast("int")))
    source = str(tmp_path / "source")
    f.write.parquet(source)
    f = spark.read.parquet(source)
    monkeypatch.setattr(index.shared, "shared_dir", lambda _: str(tmp_path))
    whole = index.build(f, str(tmp_path / "whole"))
    held = lambda df: sorted(map(str, df.collect()))
    assert {r["path"]: r["dl"] for r in whole.lengths.collect()} == {"/a/Red Boat.md": 10, "/a/boat.txt": 6}
    assert {r["term"]: r["df"] for r in whole.vocab.collect()}["boat"] == 1
    there = lambda: set(index.shared.names(spark, index.path_of(f)))
    for table, parts in (("grams", {"names"}), ("vocab", {"vocab", "names"}), ("lengths", {"vocab", "names", "lengths"}), ("postings", {"vocab", "names", "lengths", "postings"})):
        assert held(getattr(index.of(f, f), table)) == held(getattr(whole, table)), table
        assert there() == parts
    for table in ("lengths", "vocab", "stats", "postings"):
        assert held(getattr(index.open_(spark, index.path_of(f)), table).select(getattr(whole, table).columns)) == held(getattr(whole, table)), table
