"""Streams that keep a state, settings, requests as JSON and the command line."""

import io
import json

import pytest
from pyspark.sql import functions as F

from siftstone.__main__ import main
from siftstone.operators import index, origin
from siftstone.plans import settings, wire
from siftstone.streaming import reconcile

EVENTS = "t bigint, kind string, path string, path_to string, mtime bigint, size bigint"
ROW = "path string, mtime bigint, size bigint"


def put(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(folder)


def follow(spark, tmp_path, **options):
    stream = spark.readStream.schema("kind string, path string, path_to string, mtime bigint, size bigint, ts timestamp").parquet(str(tmp_path / "in"))
    return reconcile.run(stream, str(tmp_path / "out"), str(tmp_path / "state"), **options)


def held(target, spark):
    return sorted(tuple(r) for r in target.state(spark).collect())


def test_a_renamed_folder_takes_its_tree_along(spark, tmp_path):
    seen = []
    put(spark, str(tmp_path / "in"), [(1, "create", "/a/x.odt", None, 1, 1), (2, "create", "/a/b/y", None, 1, 2), (3, "create", "/n/old", None, 1, 3)])
    follow(spark, tmp_path, observe=lambda o, h: seen.append((sorted(r[0] for r in o.collect()), [r[0] for r in h.collect()])))
    assert seen == [(["/a/b/y", "/a/x.odt", "/n/old"], ["/a/x.odt"])]
    put(spark, str(tmp_path / "in"), [(4, "rename", "/a", "/n", None, None), (5, "create", "/n/new", None, 4, 4)])
    target = follow(spark, tmp_path)
    assert held(target, spark) == [("/n/b/y", 1, 2), ("/n/new", 4, 4), ("/n/x.odt", 1, 1)]
    put(spark, str(tmp_path / "in"), [(6, "remove", "/n/b", None, None, None), (7, "rename", "/n/x.odt", None, None, None)])
    target = follow(spark, tmp_path)
    assert held(target, spark) == [("/n/new", 4, 4)]
    # the last state and the one before it are kept
    assert len(list((tmp_path / "out/state").iterdir())) == 2
    # a batch that is repeated changes nothing
    number = target._last(spark)
    target(spark.createDataFrame([("remove", "/n/new", None, 0, 0)], "kind string, path string, path_to string, mtime bigint, size bigint").withColumn("ts", F.current_timestamp()), number)
    assert held(target, spark) == [("/n/new", 4, 4)]


def test_lost_events_need_a_rescan(spark, tmp_path):
    put(spark, str(tmp_path / "in"), [(1, "create", "/a/x", None, 1, 1), (1, "create", "/usb/y", None, 1, 1), (2, "overflow", "", None, None, None)])
    target = follow(spark, tmp_path, paused=True)
    assert target.state(spark) is None and not target.overflowed(spark)
    target = follow(spark, tmp_path)
    assert target.overflowed(spark)
    tree = spark.createDataFrame([("/a/x", 2, 1), ("/a/z", 1, 1)], ROW)
    away = spark.createDataFrame([("/usb",)], "prefix string")
    changes = {r["path"]: r["change"] for r in target.rescan(tree, away).collect()}
    assert changes == {"/a/x": "changed", "/a/z": "new"} and not target.overflowed(spark)
    assert held(target, spark) == [("/a/x", 2, 1), ("/a/z", 1, 1), ("/usb/y", 1, 1)]
    # a service that begins compares the whole tree as well
    first = reconcile.Reconciler(str(tmp_path / "new"))
    assert first.rescan(tree, away).count() == 2 and held(first, spark) == [("/a/x", 2, 1), ("/a/z", 1, 1)]
    put(spark, str(tmp_path / "in"), [(9, "remove", "/a/z", None, None, None)])
    assert held(follow(spark, tmp_path), spark) == [("/a/x", 2, 1), ("/usb/y", 1, 1)]


def test_backfill():
    b = reconcile.Backfill()
    assert not b.runs(False)
    b = b.request()
    assert b.runs(False) and not b.runs(True) and b.wait(0) == 5
    b = b.went_on("/m").request()
    assert (b.cursor, b.again) == ("/m", True)
    b = b.ended(100)
    assert b.pending and b.cursor is None and not b.again
    b = b.ended(100, retry_in=60)
    assert b.pending and b.wait(100) == 60
    b = b.search(200)
    assert b.hurry and b.wait(200) == 5 and b.search(203).wait(203) == 2
    for k in range(12):
        b = b.failed(1000)
    assert b.wait(1000) == 600 and b.request().until is None
    assert b.went_on("x").failures == 0 and not b.ended(0).ended(0).pending


def test_settings():
    s = settings.Settings()
    assert settings.read(None) == settings.read("") == s and settings.preset_of(s) == "balanced"
    for name in settings.PRESETS:
        made = settings.with_preset(s, name)
        assert settings.preset_of(made) == name and settings.read(settings.write(made)) == made
    with pytest.raises(KeyError):
        settings.with_preset(s, "none")
    bad = '[defaults]\nnames_only = true\n[origin]\nenabled = "yes"\n[history]\nkeep_days = 7\n[[source]]\npath = "/a"\n[[source]]\nname = "x"\n'
    with pytest.raises(ValueError):
        settings.parse(bad)
    got = settings.read(bad)
    assert got.defaults.names_only and not got.origin.enabled and got.history.keep_days == 7 and got.sources == ({"path": "/a"},)
    lost = settings.read("[defaults\n")
    assert not lost.origin.enabled and not lost.history.enabled and lost.defaults == s.defaults
    gib = settings.GIB
    assert [settings.caps(s.defaults, m).extract >> 20 for m in (None, 2 * gib, 4 * gib, 8 * gib, 64 * gib)] == [8, 4, 8, 16, 32]
    assert settings.caps(settings.Defaults(extract_max_mb=999), None).extract == 128 << 20
    assert settings.caps(s.defaults, 2 * gib).office == 64 << 20 and settings.caps(s.defaults, 8 * gib).office == 256 << 20
    assert not settings.counts_occurrences(s.defaults, None) and settings.counts_occurrences(s.defaults, 8 * gib)


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    rows = [("/h/a.md", "a.md", "a", "md", 5, "stars above"), ("/h/star.txt", "star.txt", "star", "txt", 9, "nothing"), ("/u/c.md", "c.md", "c", "md", 7, "a star")]
    f = spark.createDataFrame(rows, "path string, name string, stem string, ext string, mtime bigint, text string").withColumns({"mime": F.lit("text/plain"), "source": F.lit("s"), "size": F.col("mtime")})
    i = index.build(f, str(tmp_path_factory.mktemp("x") / "i"))
    none = spark.createDataFrame([], "path string, kind string, confidence int, label string, source_app string, source_path string, source_device_id string, source_device_label string, source_domain string, first_seen_at bigint, updated_at bigint")
    documents = spark.createDataFrame([(1, "/h/a.md", 5, 0, 5)], "id bigint, path string, mtime_s bigint, mtime_ns bigint, size bigint")
    versions = spark.createDataFrame([(1, 1, 10, 5, 0, 5, "saved"), (2, 1, 9, 4, 0, 3, "saved")], "id bigint, file_id bigint, saved_at bigint, mtime_s bigint, mtime_ns bigint, size bigint, reason string")
    return wire.Service(i, settings.Settings(), none, documents, versions)


def ask(service, **said):
    return json.loads(wire.reply(service, json.dumps(said)))


def test_requests(service):
    got = ask(service, cmd="query", q="star", mode="both", page={"limit": 2})
    assert [h["path"] for h in got["hits"]] == ["/h/star.txt", "/u/c.md"] and (got["total"], got["next_offset"]) == (3, 2)
    assert [h["path"] for h in ask(service, cmd="query", mode="list", filter={"ext": ["md"]})["hits"]] == ["/u/c.md", "/h/a.md"]
    assert ask(service, cmd="register_copy", src="/x/o", dst="/h/a.md", app="app", now=3)["ok"]
    assert ask(service, cmd="register_move", src="/h/a.md", dst="/h/b.md", now=4)["ok"]
    assert ask(service, cmd="origin", path="/h/a.md")["origin"] is None
    assert ask(service, cmd="origin", path="/h/b.md")["origin"]["kind"] == "local_copy"
    assert ask(service, cmd="register_move", src="/h/zz", dst="/h/y", now=4)["ok"] and ask(service, cmd="origin", path="/h/y")["origin"]["kind"] == "moved_or_renamed"
    assert [v["id"] for v in ask(service, cmd="versions", path="/h/a.md")["versions"]] == [2]
    assert ask(service, cmd="forget_versions", path="/h/a.md")["ok"] and ask(service, cmd="versions", path="/h/a.md")["versions"] == []
    assert ask(service, cmd="pause")["ok"] and ask(service, cmd="reindex", path="/h")["ok"]
    status = ask(service, cmd="status")
    assert status["paused"] and status["wanted"] == ["reindex:/h"] and status["documents"] == {"name": 3, "content": 3}
    assert "file_origin" in status["capabilities"]
    assert ask(service, cmd="resume")["ok"] and ask(service, cmd="clear_origin")["ok"] and ask(service, cmd="origin", path="/h/y")["origin"] is None
    assert ask(service, cmd="sources")["sources"] == []
    for bad in ("no json", "[]", '{"cmd": "nothing"}', '{"cmd": "query", "v": 9}', '{"cmd": "origin"}', '{"cmd": "query", "filter": {"size": [1]}}', '{"cmd": "' + "x" * 70_000 + '"}'):
        assert not json.loads(wire.reply(service, bad))["ok"]


def test_command_line(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta gamma", "en", "a", 9), (2, "delta", "en", "b", 5)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda *a, lines=(): (lambda out: (main(["--tables", str(tmp_path), *a], spark, out, lines), out.getvalue())[1])(io.StringIO())
    assert run("name", "delta").split() == ["/home/b/en/delta-2.html"]
    assert run("content", "alpha", "-e", "md").split() == ["/home/a/en/alpha_beta_gamma-1.md"]
    assert run("count").strip() == "2" and "list-largest" in run("capabilities")
    assert json.loads(run("serve", lines=['{"cmd": "query", "q": "delta"}']))["total"] == 1
    assert "names_only = true" in run("config", "preset", "names-only")
    (tmp_path / "x.md").write_text("Plans of the town\nOslo Council\nissued on 3 May 2031")
    assert run("info", str(tmp_path / "x.md"), "--name").strip().endswith("Plans of the town.md")
    assert json.loads(run("info", str(tmp_path / "x.md")))["date"] == "2031-05-03"


def test_identity_of_moved_origins(spark):
    o = spark.createDataFrame([("/a", "web_download", 3, "x", 1, 7, 5), ("/b", "local_copy", 3, "y", 1, 7, 9)], "path string, kind string, confidence int, label string, dev int, ino int, updated_at int").withColumn("first_seen_at", F.col("updated_at"))
    f = spark.createDataFrame([("/a", 2, 2), ("/q", 1, 7), ("/r", 3, 3)], "path string, dev int, ino int")
    got = {r["path"]: r["origin"] and r["origin"]["kind"] for r in origin.lookup(f, o).collect()}
    assert got == {"/a": "web_download", "/q": "local_copy", "/r": None}
