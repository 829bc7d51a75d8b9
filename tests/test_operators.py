import pytest
from pyspark.sql import functions as F

from siftstone.docinfo import columns as info
from siftstone.functions import paths, text
from siftstone.operators import catalogue, history, mime, origin
from siftstone.streaming import reconcile

ROW = "path string, mtime bigint, size bigint"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scan_changes_and_trees(spark):
    known = spark.createDataFrame([("/a/x", 1, 1), ("/a/y", 1, 1), ("/ab", 1, 1), ("/a", 1, 0)], ROW)
    seen = spark.createDataFrame([("/a/x", 1, 1), ("/ab", 2, 1), ("/new", 1, 1)], ROW)
    got = {r["path"]: r["change"] for r in catalogue.scan_changes(seen, known).collect()}
    assert got == {"/a/x": "unchanged", "/a/y": "gone", "/ab": "changed", "/new": "new", "/a": "gone"}
    roots = spark.createDataFrame([("/a",)], "root string")
    assert [r["path"] for r in catalogue.remove_trees(known, roots).collect()] == ["/ab"]
    sets = spark.createDataFrame([("/a/x", 9, 9)], ROW)
    assert sorted(r["path"] for r in catalogue.apply_changes(known, sets, roots).collect()) == ["/a/x", "/ab"]


def test_filters(spark):
    f = spark.createDataFrame([("/d/archive.tar.gz", "application/gzip", 1, 1), ("/d/B.GZ", "application/gzip", 2, 2), ("/dx/c.mp4", "video/mp4", 3, 3), ("/d", "inode/directory", 4, 0)], "path string, mime string, mtime bigint, size bigint")
    pick = lambda **k: sorted(r["path"] for r in f.where(catalogue.filters(**k)).collect())
    assert pick(ext=["gz"]) == ["/d/B.GZ", "/d/archive.tar.gz"]
    assert pick(ext=["tar.gz", "", "."]) == []
    assert pick(under="/d") == ["/d/B.GZ", "/d/archive.tar.gz"]
    assert pick(mime=["video/*"]) == ["/dx/c.mp4"]
    assert pick(kind="folder") == ["/d"]
    assert pick(size=(2, 3)) == ["/d/B.GZ", "/dx/c.mp4"]


def test_retention(spark):
    now = 10_000_000
    ages = [10, 20, 30, 4000, 4100, 90_000, 90_100, 700_000, 9_000_000]
    v = spark.createDataFrame([(k, 1, now - a, 5, "before_restore" if a == 90_100 else "saved") for k, a in enumerate(ages)], "id bigint, file_id bigint, saved_at bigint, size bigint, reason string")
    kept = {r["id"] for r in history.retention(v, now).where("kept").collect()}
    assert kept == {0, 3, 5, 6, 7}
    old = spark.createDataFrame([(1, 1, 0, 5, "saved")], v.schema)
    assert history.retention(old, now).first()["kept"]
    assert {r["id"] for r in history.evict(v, 12).collect()} == {8, 7, 6}


def test_mime(spark):
    globs = mime.parse_globs(spark.createDataFrame([("50:text/x-c++src:*.C:cs",), ("50:text/x-csrc:*.c",), ("50:application/x-tar:*.tar.gz",), ("50:application/gzip:*.gz",), ("60:text/x-make:Makefile",)], "line string"))
    f = spark.createDataFrame([("/1", "a.C", 1), ("/2", "a.c", 1), ("/3", "x.tar.gz", 1), ("/4", "Makefile", 1), ("/5", "e.gz", 0), ("/6", "none", 1)], "path string, name string, size bigint")
    got = {r["path"]: r["mime"] for r in mime.by_name(f, globs).collect()}
    assert got == {"/1": "text/x-c++src", "/2": "text/x-csrc", "/3": "application/x-tar", "/4": "text/x-make", "/5": "application/x-zerosize", "/6": "application/octet-stream"}


def test_origin_rule(spark):
    s = "path string, kind string, confidence int, label string, updated_at bigint"
    old = spark.createDataFrame([("/a", "local_copy", 2, "", 1), ("/b", "web_download", 3, "x", 1)], s)
    new = spark.createDataFrame([("/a", "web_download", 3, "y", 2), ("/b", "web_download", 3, "y", 2), ("/c", "created", 1, "", 2)], s)
    got = {r["path"]: (r["kind"], r["label"]) for r in origin.upsert(old, new).collect()}
    assert got == {"/a": ("local_copy", ""), "/b": ("web_download", "y"), "/c": ("created", "")}


@pytest.mark.parametrize("url,want", [("https://user@www.Example.org:8080/a", "example.org"), ("blob:https://a.b/x", "a.b"), ("http://[::1]/", "[::1]"), ("nothing", None), ("http:///x", None)])
def test_domain(spark, url, want):
    assert one(spark, text.domain_from_url(F.lit(url))) == want


def test_text_functions(spark):
    assert one(spark, text.webkit_to_unix(F.lit(13432880999211718))) == 1788407399
    assert one(spark, text.html_text(F.lit("<p>a<b>b</b></p><script>x</script>c &amp;lt; d<style>z"))) == "\nab\nc &lt; d"
    assert one(spark, text.decode_entities(F.lit("&#8212;&#x2014;&#X1F600;&amp;amp;&ccedil;&#0;&#xD800;&nbsp;a & b;"))) == "——😀&amp;&ccedil;&#0;&#xD800; a & b;"
    assert one(spark, text.html_element(F.lit("<TITLE> a\n b </TITLE>"), "title")) == "a b"
    assert one(spark, text.lines(F.lit("a\r\nb\x0bc\n"))) == ["a", "b", "c"]
    assert one(spark, text.markdown_headings(F.lit("# a\n## b\n# c\ntext"))) == ["a", "c", "b"]
    assert one(spark, text.truncate_bytes(F.lit("aéé"), 4)) == "aé"
    assert one(spark, paths.ancestors(F.lit("/a/b/c.txt"))) == ["/a", "/a/b"]
    assert one(spark, paths.is_hidden(F.lit("/a/.b/c")))


@pytest.mark.parametrize(
    "body,want",
    [("on 4 de outubro de 2026.", ["2026-10-04"]), ("October 4th, 2026", ["2026-10-04"]), ("2026年10月4日", ["2026-10-04"]), ("2026-02-30 and 2024-02-29", ["2024-02-29"]), ("em 04/10/2026", ["2026-10-04"]), ("4. Oktober 2026", ["2026-10-04"])],
)
def test_dates(spark, body, want):
    assert one(spark, info.dates(F.lit(body))) == want


def test_kind_and_name(spark):
    k = one(spark, info.kind(info.head(F.lit("CONTRATO DE LOCAÇÃO\nentre as partes"))))
    assert (k["kind"], k["lang"]) == ("contrato", "pt")
    name = lambda d, k, t, e: one(spark, info.suggested_name(F.lit(d).cast("string"), F.lit(k).cast("string"), F.lit(t).cast("string"), F.lit(e)))
    assert name("2026-04-22", None, "Gene therapy: Practical aspects", "pdf") == "2026-04-22 Gene therapy - Practical aspects.pdf"
    assert name(None, None, "; o", "txt") == "documento.txt"
    assert name(None, "Invoice", None, "") == "Invoice"
    assert len(name(None, None, "word " * 100, "pdf")) <= 124


def test_stream_reconcile(spark, tmp_path):
    rows = [(1, "create", "/a/x", None, 1, 1), (2, "create", "/a/y", None, 1, 2), (3, "create", "/b", None, 1, 3), (4, "rename", "/b", "/c", 1, 3), (5, "modify", "/a/x", None, 7, 9)]
    schema = "t bigint, kind string, path string, path_to string, mtime bigint, size bigint"
    events = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t"))
    events.write.parquet(str(tmp_path / "in/1"))
    spark.createDataFrame([(9, "remove", "/a", None, 0, 0)], schema).withColumn("ts", F.timestamp_seconds("t")).write.parquet(str(tmp_path / "later"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in/*"))
    target = reconcile.run(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(tuple(r) for r in target.state(spark).collect()) == [("/a/x", 7, 9), ("/a/y", 1, 2), ("/c", 1, 3)]
    spark.read.parquet(str(tmp_path / "later")).write.parquet(str(tmp_path / "in/2"))
    target = reconcile.run(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in/*")), str(tmp_path / "out"), str(tmp_path / "state"))
    assert [r["path"] for r in target.state(spark).collect()] == ["/c"]
