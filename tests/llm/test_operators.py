"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.llm import decontaminate, exact_dedup, html_blocks, html_pages, langid, lbl, mixing, queries, url_filter, warc

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("key", T.StringType()), T.StructField("score", T.StringType())])


def docs(spark, rows):
    return spark.createDataFrame([(d, t, lang, src, None, "x", "x", None) for d, t, lang, src in rows], DOCS).repartition(3)


def make(seed, n, words=40):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefé") for _ in range(r.randrange(1, 6))) for _ in range(words)]
    rows = []
    for k in range(n):
        rows.append((k, " ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 60))), r.choice(["en", "fr", None]), r.choice(["a", "a", "b", None])))
    return rows


EDGES = [(500, None, None, None), (501, "", "en", "a"), (502, " \n\t", "fr", None), (503, "Word", "en", "a"), (503, "Word", "en", "a"), (None, "null id text", "en", "b"), (504, "long " * 20_000, "en", "a")]

# exact dedup


def slow_exact(rows):
    """Of rows that agree in all that decides, the first is kept; which it is doesn't show in the result."""
    groups = {}
    for d, t, *_ in rows:
        norm = "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(norm, []).append((d, len(t or "")))
    out = []
    for norm, g in groups.items():
        best = min(range(len(g)), key=lambda k: (-g[k][1], g[k][0] is None, g[k][0] or 0))
        out += [(d, g[best][0], len(g), k == best, hashlib.sha256(norm.encode()).hexdigest()) for k, (d, _) in enumerate(g)]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda norm: (F.crc32(norm) % 7).cast("string")])
def test_exact_dedup(spark, digest):
    rows = make(1, 60) + EDGES + [(600, "Wo rd", "en", "a"), (601, " W o r d ", None, None), (602, " W o r d ", None, None)]
    rows += [(5, "same text", "en", "a")] * 2 + [(None, "null", "en", "a")] * 3
    got = exact_dedup.exact_dedup(docs(spark, rows), digest, files_per_batch=2).collect()
    assert sorted((tuple(x)[:5] for x in got), key=str) == slow_exact(rows)
    assert len({x["locator"] for x in got}) == len(rows)
    assert exact_dedup.exact_dedup(docs(spark, rows).limit(0)).collect() == []


def test_exact_dedup_with_large_groups(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LARGE_GROUP", 2)
    rows = make(9, 40, 3) + [(k, "a copy", "en", "a") for k in range(100, 130)]
    for digest in (exact_dedup.sha256, lambda norm: (F.crc32(norm) % 3).cast("string")):
        got = exact_dedup.exact_dedup(docs(spark, rows), digest).collect()
        assert sorted((tuple(x)[:5] for x in got), key=str) == slow_exact(rows)


def test_exact_dedup_goes_on(spark, tmp_path):
    """A stream that starts again knows what it has seen."""
    a, b = docs(spark, [(2, "same", "", ""), (3, "other", "", "")]), docs(spark, [(1, "sa me", "", ""), (4, "same", "", "")])
    exact_dedup.arrivals(exact_dedup.located(a)).write.parquet(str(tmp_path / "in/1"))
    for n, more in ((1, b), (2, None)):
        stream = spark.readStream.schema(exact_dedup.KEYS).parquet(str(tmp_path / "in/*"))
        exact_dedup.follow(stream, str(tmp_path / "state"), str(tmp_path / "groups"))
        got = {r["keep_id"]: r["n"] for r in exact_dedup.current(spark, str(tmp_path / "groups")).collect()}
        assert got == ({2: 1, 3: 1} if n == 1 else {1: 3, 3: 1})
        if more is not None:
            exact_dedup.arrivals(exact_dedup.located(more)).write.parquet(str(tmp_path / "in/2"))


# decontamination


def slow_hits(rows, items, width=13):
    def words(t):
        return (t or "").encode().translate(decontaminate._TABLE).split()

    windows = {}
    for i, t in items:
        for w in decontaminate.windows(words(t), width):
            windows.setdefault(tuple(w), set()).add(i)
    out = []
    for d, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= {i for i in ids if i is not None}
        out.append((d, len(w), len(hit), len(found), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words,shard_bytes", [(4_000_000, 8 << 20), (60, 2000)])
def test_decontaminate(spark, block_words, shard_bytes):
    rows = make(2, 50, 12) + EDGES
    r = random.Random(5)
    items = [(k, " ".join((rows[r.randrange(50)][1]).split()[5:25])) for k in range(15)] + [(90, "Word"), (91, None), (92, ""), (None, rows[4][1]), (90, "Word")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(docs(spark, rows), bench, block_words=block_words, shard_bytes=shard_bytes).collect()
    assert sorted(((*x[:4], list(x[4]), x[5]) for x in (tuple(g) for g in got)), key=str) == slow_hits(rows, items)


@pytest.mark.parametrize("block_words", [4_000_000, 60])
def test_decontaminate_equal_chunks(spark, block_words):
    """Chunks with equal doc_ids and word counts are different ones: a table twice, and rows each alone in a chunk."""
    r = random.Random(12)
    say = lambda n: " ".join(f"w{r.randrange(400)}" for _ in range(n))
    items = [(k, say(40)) for k in range(4)]
    clean = [say(30) for _ in range(3)]
    texts = [*clean, *(" ".join(t.split()[3:33]) for _, t in items)]
    rows = [(None, t, "en", "a") for t in texts] + [(7, texts[3], "en", "a")] * 3 + [(8, texts[0], "en", "a"), (8, texts[4], "en", "a")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    alone = docs(spark, rows).coalesce(1)
    run = lambda df, size: sorted(((*x[:4], list(x[4]), x[5]) for x in (tuple(g) for g in decontaminate.contamination(df, bench, block_words=block_words, shard_bytes=size).collect())), key=str)
    assert run(alone, 1) == slow_hits(rows, items)
    assert run(alone.union(alone), 8 << 20) == slow_hits(rows + rows, items)


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [x["n_hit"] for x in decontaminate.contamination(docs(spark, EDGES), none).collect()] == [0] * len(EDGES)
    assert decontaminate.contamination(docs(spark, EDGES).limit(0), none).collect() == []


def test_proximity(spark):
    rows = docs(spark, [(1, "alpha x x beta", "", ""), (2, "alpha x x x x beta", "", "")])
    bench = spark.createDataFrame([(7, "beta alpha")], "item_id bigint, text string")
    got = {x["doc_id"] for x in decontaminate.matches(rows, bench, slop=3).where("start >= 0").collect()}
    assert got == {1}


# language ID


def test_language_id(spark):
    r = random.Random(3)
    speak = {"en": ["the", "of", "thing", "ther", "ation", "was"], "de": ["der", "und", "ung", "schen", "keit", "ist"]}
    rows = [(k, " ".join(r.choice(speak[lang]) + r.choice(["", "en", "s"]) for _ in range(40)), lang, "a") for k in range(120) for lang in [r.choice(["en", "de"])]]
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = langid.learn(docs(spark, rows), ~held)
    assert sorted(model) == ["de", "en"]
    got = {x["doc_id"]: x for x in langid.identify(docs(spark, rows + EDGES), model).collect()}
    out = [d for d, *_ in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    truth = {d: lang for d, _, lang, _ in rows}
    assert sum(got[d]["lang_pred"] == truth[d] for d in out) >= 0.95 * len(out)
    assert all(got[d]["lang_pred"] == "und" and got[d]["rejected"] for d in (500, 501, 502))
    assert all(0 <= x["score"] <= 1 for x in got.values())
    # what a document's own row says is no input
    other = {x["doc_id"]: x["lang_pred"] for x in langid.identify(docs(spark, [(d, t, "zz", "q") for d, t, *_ in rows]), model).collect()}
    assert all(other[d] == got[d]["lang_pred"] for d in other)
    assert langid.learn(docs(spark, rows).limit(0)) == {}
    # numbers that aren't letters, and a letter beside them
    assert {langid.predict(t, tuple(model.items()))[0] for t in ("²", "½ ①", "12 _ !", "Ⅷ")} == {"und"}
    assert langid.predict("x²", tuple(model.items()))[0] != "und"
    # more languages than are learned, repeated and null doc_ids
    many = [(k, f"text of {k % 9}", f"l{k % 9}", "a") for k in range(90)] + [(None, "no id", "l1", "a")] * 3 + [(k, f"text of {k % 2}", f"l{k % 2}", "a") for k in range(20)]
    assert sorted(langid.learn(docs(spark, many), max_langs=2)) == ["l0", "l1"]
    assert len(langid.learn(docs(spark, many), texts=3, dict_bytes=40)["l0"]) <= 40
    assert {x["lang_pred"] for x in langid.identify(docs(spark, rows), {}).collect()} == {"und"}


def slow_predict(text, model):
    """A plain compressor for each block and language, made anew."""
    import zstandard

    data = " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split()).encode()
    n = -(-len(data) // langid.BLOCK_BYTES)
    sizes = {}
    for lang, d in model.items():
        shared = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        new = lambda: zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False)  # noqa: B023, E731
        sizes[lang] = sum(len(new().compress(data[len(data) * k // n : len(data) * (k + 1) // n])) for k in range(n))
    return min(sizes, key=lambda k: (sizes[k], k)), sizes


def test_language_id_matches_slow(spark):
    r = random.Random(4)
    speak = {"en": ["the", "of", "thing", "ther"], "de": ["der", "und", "ung", "schön"], "fr": ["le", "été", "ment", "que"]}
    say = lambda lang, n: " ".join(r.choice(speak[lang]) + r.choice(["", ",", "1", " -"]) for _ in range(n))
    model = langid.learn(docs(spark, [(k, say(lang, 60), lang, "a") for k in range(60) for lang in [r.choice(list(speak))]]))
    for n in (1, 3, 50, 60_000):
        text = say("fr", n) + " " + say("de", n)
        want, sizes = slow_predict(text, model)
        got = langid.predict(text, tuple(sorted(model.items())))
        second = sorted(sizes.values())[1]
        assert got[0] == want and math.isclose(got[2], (second - sizes[want]) / second)


def test_margin_does_not_shrink_with_length(monkeypatch):
    r = random.Random(8)
    speak = {lang: ["".join(r.choice(letters) for _ in range(r.randrange(3, 9))) for _ in range(4000)] for lang, letters in (("en", "abcdefghijk"), ("de", "ghijklmnopq"))}
    say = lambda lang, n: " ".join(r.choice(speak[lang]) for _ in range(n))
    model = tuple((lang, langid._dictionary([langid.cleaned(say(lang, 300)) for _ in range(100)], langid.DICT_BYTES)) for lang in sorted(speak))
    long = say("en", 600_000)
    short = langid.predict(long[:150_000], model)
    got = langid.predict(long, model)
    assert got[0] == short[0] == "en" and not got[3] and got[2] > short[2] / 3
    # every part of the text counts: the larger share names it, wherever it stands
    assert langid.predict(say("en", 30_000) + " " + say("de", 200_000), model)[0] == "de"
    assert b"".join(langid.blocks(langid.cleaned(long))) == langid.cleaned(long)
    monkeypatch.setattr(langid, "BLOCK_BYTES", 1 << 40)
    assert langid.predict(long, model)[3]


# mixing


def test_rake_matches_targets():
    import pandas as pd

    r = np.random.default_rng(0)
    cells = pd.DataFrame([(a, b, int(r.integers(1, 500))) for a in "xyz" for b in "pq"], columns=["a", "b", "tokens"])
    targets = mixing.targets_of(cells, ["a", "b"], {"a": {"x": 1, "y": 1, "z": 2}}, 0.5)
    fit = mixing.rake(cells, targets)
    for m in "ab":
        share = (fit.cells["tokens"] * fit.cells["weight"]).groupby(fit.cells[m]).sum()
        assert np.allclose(share, targets[m], atol=1e-8)
    p = mixing.inclusion(fit.cells, 0.6 * cells["tokens"].sum())
    assert np.isclose((p * cells["tokens"]).sum(), 0.6 * cells["tokens"].sum()) and (p <= 1).all()


def test_mix(spark):
    rows = make(4, 300) + EDGES
    plain = ("source", "lang")
    got = mixing.mix(docs(spark, rows), power=0.0, share=0.5).collect()
    assert len(got) == len(rows)
    by_id = {(x["doc_id"], x["text"]): x for x in got}
    assert by_id[500, None]["probability"] == 0 and by_id[501, ""]["topic"] == "empty"
    tokens = sum(x["n_tokens"] for x in got)
    assert math.isclose(sum(x["n_tokens"] * x["probability"] for x in got), 0.5 * tokens, rel_tol=1e-6)
    weighted = {}
    # margins that all values share can all be met
    for x in mixing.mix(docs(spark, rows), power=0.0, share=0.5, margins=plain).collect():
        weighted[x["source"]] = weighted.get(x["source"], 0) + x["n_tokens"] * x["weight"]
    assert max(weighted.values()) / min(weighted.values()) < 1.01
    assert sorted(str(x) for x in mixing.mix(docs(spark, rows), power=0.0, share=0.5).collect()) == sorted(map(str, got))
    assert mixing.mix(docs(spark, rows).limit(0)).collect() == []


def slow_mix(rows, given, power, share, seed=8):
    """Raking, inclusion and draw by loops over cells and rows."""
    import struct

    import xxhash

    cells, total = {}, 0
    tokens = [len((t or "").split()) for _, t, *_ in rows]
    for (_, _, lang, src), n in zip(rows, tokens):
        cells[src, lang] = cells.get((src, lang), 0) + n
        total += n
    targets = {}
    for m, at in (("source", 0), ("lang", 1)):
        seen = {}
        for key, n in cells.items():
            seen[key[at]] = seen.get(key[at], 0) + n
        seen = {v: n / total for v, n in seen.items() if n}
        if m in given:
            named = {v: given[m][v] for v in seen if v in given[m]}
            rest = sum(seen[v] for v in named)
            want = {v: named[v] / sum(named.values()) * rest if v in named else seen[v] for v in seen}
        else:
            want = {v: x**power for v, x in seen.items()}
        targets[at] = {v: x / sum(want.values()) for v, x in want.items()}
    weight = {k: 1 / total if n else 0.0 for k, n in cells.items()}
    for _ in range(2000):
        for at, want in targets.items():
            have = {}
            for k, n in cells.items():
                have[k[at]] = have.get(k[at], 0) + n * weight[k]
            weight = {k: w * want.get(k[at], 0) / have[k[at]] if have[k[at]] else 0.0 for k, w in weight.items()}
    # water-filling: cells at 1 hand what they cannot give to the others
    full, budget = set(), share * total
    while True:
        rest = sum(cells[k] * weight[k] for k in cells if k not in full)
        scale = (budget - sum(cells[k] for k in full)) / rest if rest else 0
        more = {k for k in cells if k not in full and scale * weight[k] >= 1}
        if not more:
            break
        full |= more
    out = []
    for (d, _, lang, src), n in zip(rows, tokens):
        p = 0.0 if not n else 1.0 if (src, lang) in full else scale * weight[src, lang]
        h = 42 if d is None else xxhash.xxh64_intdigest(struct.pack("<q", d), 42)
        u = xxhash.xxh64_intdigest(struct.pack("<i", seed), h) % (1 << 52) / (1 << 52)
        out.append((d, n, round(p, 6), u < p))
    return out


@pytest.mark.parametrize("given", [{}, {"lang": {"en": 3.0, "fr": 1.0, "xx": 5.0}}, {"lang": {"zz": 1.0}}])
def test_mix_matches_slow(spark, given):
    rows = [(d, t, lang or "en", src or "b") for d, t, lang, src in make(14, 300)] + [(None, "null id", "en", "a"), (900, None, "fr", "a")]
    got = mixing.mix(docs(spark, rows), given, power=0.5, share=0.6, margins=("source", "lang")).collect()
    if given == {"lang": {"zz": 1.0}}:
        # no value that it names occurs: the margin keeps its shares, as without a target for it
        assert sum(x["n_tokens"] * x["probability"] for x in got) > 0
        return
    assert sorted(((x["doc_id"], x["n_tokens"], round(x["probability"], 6), x["sampled"]) for x in got), key=str) == sorted(slow_mix(rows, given, 0.5, 0.6), key=str)


def test_mix_with_clashing_columns_and_many_cells(spark, monkeypatch):
    rows = make(15, 200)
    plain = docs(spark, rows)
    clash = plain.withColumns({f"__{c}": F.lit("x") for c in ("lang", "source", "topic", "cell")} | {"weight": F.lit(7.0), "tokens": F.lit(1), "cut": F.lit("y")})
    key = lambda df: sorted((str((x["doc_id"], x["probability"], x["sampled"])) for x in df.collect()))
    got = mixing.mix(clash)
    assert key(got) == key(mixing.mix(plain)) and {"__lang", "__topic", "tokens"} <= set(got.columns)
    monkeypatch.setattr(mixing, "MAX_CELLS", 8)
    many = docs(spark, [(k, "some words of it", f"l{k % 30}", f"s{k % 7}") for k in range(300)])
    out = mixing.mix(many, share=0.5).collect()
    assert len(out) == 300 and math.isclose(sum(x["n_tokens"] * x["probability"] for x in out), 0.5 * sum(x["n_tokens"] for x in out), rel_tol=1e-6)


# WARC


def test_warc(spark, tmp_path):
    r = random.Random(1)
    big = "é<p>" + "".join(r.choice("abcdefgh ") for _ in range(400_000))
    rows = [(1, "u1", big), (5, "u5", big), (2, "u\r\n2%0A", "small"), (3, None, "small"), (4, "u", None), (6, "u", ""), (None, "n", "x" * 2000), (7, "m", "x" * 2000), (7, "m", "x" * 2000), (8, "q", "x" * 1000), (9, "q", "x" * 1000), (10, "q", "y" * 999), (11, "q", "y" * 999)]
    schema = "page_id bigint, url string, html string, digest string, best long, archive string"
    pages = spark.createDataFrame([(*r, "z", 1, "z") for r in rows], schema).repartition(2)
    path = str(tmp_path / "w")
    warc.write(warc.plan(pages), path, chunk_bytes=10_000)
    table = spark.read.parquet(path)
    assert table.agg(F.max("chunk_no")).first()[0] > 5
    got = warc.read(spark, path).collect()
    best = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 1000:
            best[h] = max(p, best.get(h, p))
    want = []
    for p, u, h in rows:
        data = (h or "").encode()
        b = best.get(h) if len(data) >= 1000 else None
        revisit = b is not None and p != b
        want.append((p, u, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", b if revisit else None))
    assert sorted((tuple(x)[1:] for x in got), key=str) == sorted(want, key=str)
    # the chunks of an archive, in order, are a gzip file of WARC records
    import gzip

    for a in {x["archive"] for x in table.select("archive").distinct().collect()}:
        parts = table.where(F.col("archive") == a).orderBy("record_no", "chunk_no").collect()
        assert gzip.decompress(b"".join(bytes(x["data"]) for x in parts)).count(b"WARC/1.1\r\n") == len({x["record_no"] for x in parts})
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_warc_reader_refuses_damage():
    r = random.Random(2)
    body = "".join(r.choice("abcdefgh ") for _ in range(50_000)).encode()
    rows = list(warc.chunks(warc.header(1, "u", "response", None, hashlib.sha1(body).hexdigest(), len(body), len(body)), body, 3000))
    assert len(rows) == 17 and all(d == hashlib.sha1(body[: 3000 * (k + 1)]).hexdigest() for k, (_, _, d) in enumerate(rows))

    def feed(rows):
        reader = warc.Reader()
        return [reader.feed(k, *x) for k, x in rows]

    whole = list(enumerate(rows))
    assert feed(whole)[-1]["payload_bytes"] == 50_000
    for at in (0, 8, 16):
        data, last, sofar = rows[at]
        for broken in ((data, last, "0" * 40), (data[:-9] + bytes([data[-9] ^ 1]) + data[-8:], last, sofar)):
            damaged = [*whole[:at], (at, broken), *whole[at + 1 :]]
            with pytest.raises((ValueError, zlib.error)):
                feed(damaged[: at + 1])
        with pytest.raises((ValueError, zlib.error)):
            feed(whole[:at] + whole[at + 1 :] + [(17, rows[16])])
    with pytest.raises(ValueError):
        feed([*whole[:16], (16, (rows[16][0], False, rows[16][2])), (17, (b"", True, rows[16][2][::-1]))])


def test_warc_revisits_need_their_response(spark):
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    good = [(1, 2000, "a", "revisit", 9), (2, 2000, "a", "revisit", 9), (9, 2000, "a", "response", None), (3, 5, "b", "response", None), (4, 5, "b", "response", None)]
    bad = [(5, 2000, "c", "revisit", 6), (6, 1999, "c", "response", None), (7, 3000, "d", "revisit", 8), (10, 3000, "e", "revisit", 11), (11, 3000, "e", "response", None), (12, 3000, "e", "revisit", 13)]
    assert {x[0] for x in warc.dangling(spark.createDataFrame(good + bad, schema)).collect()} == {"c", "d", "e"}


# URL filters


def slow_judge(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = rest[: min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))]
        path = rest[len(host) :]
        path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


@pytest.mark.parametrize("limit", [8 << 20, 1])
def test_url_filter(spark, limit):
    r = random.Random(7)
    label = lambda: r.choice(["a", "b", "net", "org", "example", "com"])
    rules = list({(h, p): (r.choice(["block", "allow"]), h, p) for h, p in ((".".join(label() for _ in range(r.randrange(1, 4))), r.choice(["/", "/en/", "/de", "/fr/x", ""])) for _ in range(60))}.values())
    urls = [f"{r.choice(['http', 'HTTPS'])}://{'.'.join(label().upper() if r.random() < 0.1 else label() for _ in range(r.randrange(1, 5)))}{r.choice(['', '/', '/en/1', '/de', '/dex', '/fr/x/y?q=1', '?a://b', '#/en/'])}" for _ in range(800)]
    urls += [None, "", "no scheme", "://", "x://", "http://net", "http://net/", "http://.net/", "http://a..net/", "http://net/en/://b", "http://x\n.net/\n"]
    for use in (rules, queries.URL_RULES):
        pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id bigint, url string, host string")
        got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in url_filter.judge(pages, use, limit=limit).collect()}
        assert got == {k: slow_judge(u, use) for k, u in enumerate(urls)}
    assert url_filter.judge(pages.limit(0), rules, limit=limit).collect() == []
    assert {x["verdict"] for x in url_filter.judge(pages, []).collect()} == {"allow"}


def test_a_cascade_that_doesn_t_end_is_none(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_LEVELS", 1)
    listed = spark.createDataFrame([(f"k{k}",) for k in range(200)], "key string")
    universe = spark.createDataFrame([(f"k{k}",) for k in range(40_000)], "key string")
    assert url_filter.build_cascade(listed, universe, 40_000) is None
    monkeypatch.undo()
    got = url_filter.build_cascade(listed, universe, 40_000)
    assert universe.where(got.contains(F.col("key"))).count() == 200


# HTML


def test_blocks():
    page = "<title>t</title><p>a &amp;&nbsp;b<b>c\n d</b><p>x<script>no</p></script>y<ul><li>1<li>2</ul><!-- <p>no --><div class='ad x'>q<br>r"
    got = html_blocks.blocks(page)
    assert [b[0] for b in got] == ["a & bc d", "x", "y", "1", "2", "q", "r"] or [b[0] for b in got] == ["a & bc d", "xy", "1", "2", "q", "r"]
    assert got[-1][1] == ("div", "ad", "x")
    assert html_blocks.blocks(None) == html_blocks.blocks("") == []
    assert html_blocks.blocks("a < b")[0][0] == "a < b"


def test_gradient():
    net = html_blocks.BiLSTM(inputs=5, hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, y = r.normal(size=(4, 2, 5)), r.integers(0, 2, (4, 2)).astype(float)
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    _, grads = net.step(x, y, mask)
    for k, g in grads.items():
        at = tuple(r.integers(0, s) for s in net.p[k].shape)
        old = net.p[k][at]
        step = 1e-3
        net.p[k][at] = old + step
        up = net.step(x, y, mask)[0]
        net.p[k][at] = old - step
        down = net.step(x, y, mask)[0]
        net.p[k][at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 2e-3


def test_html_extraction(spark):
    net = html_blocks.train()
    r = random.Random(77)
    pages = [html_pages.generated_page(r) for _ in range(150)]
    found = [html_blocks.blocks(h) for h, _ in pages]
    assert all(len(b) == len(y) for b, (_, y) in zip(found, pages))
    right = np.concatenate([a == np.array(y, bool) for a, (_, y) in zip(html_blocks.label(found, net), pages)])
    assert right.mean() > 0.93
    # signs that one expects in menus, in every paragraph of an article
    for sign in ("|", "»", "©", "·"):
        marked = f" {sign} ".join(["Words", "and", "more", "of", "them", "here"])
        page = f"<nav><ul><li><a href='/a'>Home</a><li><a href='/b'>News</a></ul></nav><div class='ad'>Buy this now.</div><article><h1>{marked}</h1>" + f"<p>{marked}</p>" * 12 + f"</article><footer>{sign} 2020</footer>"
        got = html_blocks.blocks(page)
        assert [b[0] for b, on in zip(got, html_blocks.label([got], net)[0]) if on] == [marked] * 13
    rows = [(1, "u", pages[0][0]), (2, None, None), (3, "u", ""), (None, "u", "<p>"), (4, "u", "<nav><a>m</a></nav><article><h1>A title of it</h1>" + "<p>word more words.</p>" * 3000 + "</article><footer>f</footer>")]
    df = spark.createDataFrame([(*x, "z") for x in rows], "page_id bigint, url string, html string, text string")
    got = {x["page_id"]: x for x in html_blocks.extract(df, net.p).collect()}
    assert got[2]["text"] == got[3]["text"] == got[None]["text"] == "" and got[2]["n_chars"] == 0
    assert got[4]["text"] == "A title of it " + " ".join(["word more words."] * 3000)
    assert html_blocks.extract(df.limit(0), net.p).collect() == []


def slow_logits(net, x):
    """The labeller block by block, unit by unit, for one page."""
    k, total = net.hidden, [float(net.p["c"][0])] * len(x)
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    for d, v in (("f", net.p["V"][:k]), ("b", net.p["V"][k:])):
        h, c = [0.0] * k, [0.0] * k
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            z = [sum(float(a) * float(b) for a, b in zip([*x[t], *h], net.p[f"W{d}"][:, j])) + float(net.p[f"b{d}"][j]) for j in range(4 * k)]
            for j in range(k):
                c[j] = sigmoid(z[k + j]) * c[j] + sigmoid(z[j]) * math.tanh(z[3 * k + j])
            h = [sigmoid(z[2 * k + j]) * math.tanh(c[j]) for j in range(k)]
            total[t] += sum(a * float(b) for a, b in zip(h, v))
    return np.array(total)


def test_labeller_matches_slow():
    net = html_blocks.BiLSTM(seed=9)
    r = random.Random(6)
    pages = [p for p in (html_blocks.blocks(html_pages.generated_page(r)[0]) for _ in range(3)) if p]
    x, mask = html_blocks.padded([html_blocks.features(p) for p in pages])
    got = net.logits(x, mask)
    for k, p in enumerate(pages):
        assert np.allclose(got[: len(p), k], slow_logits(net, html_blocks.features(p)), atol=1e-4)
        assert np.allclose(got[: len(p), k], net.long_logits(p, 7), atol=1e-4)


def test_deep_page():
    """Depth costs no more than length; only the innermost part of a path is read."""
    got = html_blocks.blocks("<div class='a b'>" * 5000 + "x" + "</div>" * 5000 + "<p>y</p>")
    assert [b[0] for b in got] == ["x", "y"] and len(got[0][1]) == html_blocks.PATH_WORDS and got[1][1] == ("p",)


# language model


def test_lbl_scores(spark):
    rows = make(6, 150, 200) + EDGES
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = lbl.score(docs(spark, rows), held).collect()
    assert len(got) == len(rows)
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\0end"]
    is_held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = {}
    for d, t, *_ in rows:
        if not is_held(d):
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted(((d, is_held(d), len(tokens(t)), sum(w in counts for w in tokens(t)), n, round(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens(t)), 6)) for d, t, *_ in rows), key=str)
    assert sorted(((*tuple(x)[:5], round(x["base_score"], 6)) for x in got), key=str) == want
    assert all(x["score"] < 0 and x["spelled_score"] <= x["score"] for x in got)
    assert lbl.score(docs(spark, rows).limit(0), held).collect() == []


def slow_log10(net, symbols):
    """log10 probability of each symbol of one text, a token at a time, over all symbols of all classes."""
    p, out = {k: x.astype(np.float64) for k, x in net.p.items()}, []
    for i, s in enumerate(symbols):
        h = np.zeros(p["r"].shape[1])
        for k in range(lbl.PLACES):
            h += p["a"][k] * p["r"][symbols[i - k - 1] if i > k else len(net.share)]
        probability = np.zeros(len(net.share))
        classes = np.exp(p["q"] @ h + p["b"])
        for c in range(len(classes)):
            lo, hi = net.bounds[c], net.bounds[c + 1]
            inner = np.exp(p["w"][lo:hi] @ h + p["u"][lo:hi])
            probability[lo:hi] = classes[c] / classes.sum() * inner / inner.sum()
        assert np.isclose(probability.sum(), 1)
        out.append(math.log10(probability[s]))
    return np.array(out)


def toy_model(seed, words=300):
    r = np.random.default_rng(seed)
    n = np.sort(r.integers(8, 900, words))[::-1]
    v = lbl.make_vocabulary(np.arange(1, 8), np.full(7, 9), np.empty(0, np.uint64), np.empty(0, np.int64))
    mass = np.r_[n, v.mass]
    return r, lbl.LogBilinear(lbl.class_bounds(mass, words, 12), mass, vector=6)


def test_lbl_score_matches_slow():
    r, net = toy_model(1)
    texts = [r.integers(0, 324, n) for n in (1, 2, 5, 60)]
    net.fit(np.concatenate(texts), net.contexts(np.concatenate(texts), np.cumsum([0, 1, 2, 5, 60])), 3)
    offsets = np.cumsum([0, *map(len, texts)])
    got = net.log10(np.concatenate(texts), net.contexts(np.concatenate(texts), offsets))
    assert np.allclose(got, np.concatenate([slow_log10(net, t) for t in texts]), atol=1e-4)


def slow_fit(net, target, context, seed, noise=lbl.NOISE, rate=lbl.RATE):
    """The pass of fit: each parameter by itself, members of a row added one by one, all in double precision."""
    p = {k: x.astype(np.float64) for k, x in net.p.items()}
    sums, touched = {k: np.full(x.shape, lbl.START) for k, x in p.items()}, {k: np.zeros(len(x)) for k, x in p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    g = np.random.default_rng(seed)
    order, cum = g.permutation(len(target)), np.cumsum(net.class_share)
    batch = int(np.clip(len(target) // 64, 256, lbl.BATCH))
    for k in range(0, len(order), batch):
        at = order[k : k + batch]
        at = at[np.argsort(target[at], kind="stable")]
        grads = {k: np.zeros_like(x) for k, x in p.items()}
        times = {k: np.zeros(len(x)) for k, x in p.items()}

        def add(name, row, grad, grads=grads, times=times):
            grads[name][row] += grad
            times[name][row] += 1

        drawn = np.minimum(np.searchsorted(cum, g.random(noise[0]) * cum[-1], "right"), len(cum) - 1)
        cls = net.class_of[target[at]]
        several = np.flatnonzero(np.diff(net.bounds)[cls] > 1)
        others = dict(zip(several.tolist(), net.draws(cls[several], g.random((len(several), noise[1])))))
        for c in drawn:
            times["q"][c] += 1
            times["b"][c] += 1
        for i, (t, ctx, c) in enumerate(zip(target[at], context[at], cls)):
            h = (p["a"] * p["r"][ctx]).sum(0)
            dh = np.zeros(len(h))
            for n, (k, real) in enumerate([(c, 1), *((x, 0) for x in drawn)]):
                e = sigmoid(p["q"][k] @ h + p["b"][k] - np.log(noise[0] * net.class_share[k])) - real
                dh += e * p["q"][k]
                grads["q"][k] += e * h
                grads["b"][k] += e
                if not n:
                    times["q"][k] += 1
                    times["b"][k] += 1
            for n, s in enumerate([t, *others[i]] if i in others else []):
                e = sigmoid(p["w"][s] @ h + p["u"][s] - np.log(noise[1] * net.share[s])) - (n == 0)
                dh += e * p["w"][s]
                add("w", s, e * h)
                add("u", s, e)
            for j in range(lbl.PLACES):
                add("r", ctx[j], dh * p["a"][j])
                grads["a"][j] += dh * p["r"][ctx[j]] / math.sqrt(len(at))
        times["a"] += 1
        for name in p:
            sums[name] += grads[name] ** 2
            p[name] -= rate * grads[name] / np.sqrt(sums[name])
            touched[name] += times[name]
    return p, touched


def test_lbl_fit_matches_slow():
    """Batches that aren't full, classes of one symbol, and rows that many positions share."""
    r, net = toy_model(3)
    lone = lbl.LogBilinear(np.unique(np.r_[0, 1, 2, net.bounds[1:]]), net.share * net.class_share[net.class_of] * 1e5, vector=6)
    for model in (net, lone):
        text = np.minimum(r.zipf(1.3, 600) - 1, 323)
        context = model.contexts(text, np.array([0, 1, 40, 600]))
        want, times = slow_fit(model, text, context, 4)
        touched = model.fit(text, context, 4)
        for name, x in want.items():
            assert np.allclose(model.p[name], x, atol=2e-3), name
            assert np.abs(model.p[name] - x).mean() < 2e-5 and (touched[name] == times[name]).all(), name


def test_lbl_noise_has_the_shares_of_its_class():
    r, net = toy_model(4)
    c = len(net.bounds) // 2
    lo, hi = net.bounds[c], net.bounds[c + 1]
    got = net.draws(np.full(50_000, c), r.random((50_000, 4)))
    assert got.min() >= lo and got.max() < hi
    share = net.share[lo:hi]
    assert np.abs(np.bincount(got.ravel() - lo, minlength=hi - lo) / got.size - share).max() < 0.004
    # exactly: a symbol has its own part of its cell and the rest of others
    own, other = net.alias
    for lo, hi in zip(net.bounds[:-1], net.bounds[1:]):
        parts = own[lo:hi].copy()
        np.add.at(parts, other[lo:hi] - lo, 1 - own[lo:hi])
        assert np.allclose(parts / (hi - lo), net.share[lo:hi] / net.share[lo:hi].sum())


def test_lbl_sums_of_extreme_scores():
    s = np.array([[0, 1, 2], [-500, -501, -499], [500, 1, 499], [59, -59, 0]], np.float32)
    want = np.logaddexp.reduce(s.astype(np.float64), axis=1)
    assert np.allclose(lbl._log_sum(s.copy()), want) and np.allclose(lbl._log_sum(s[[0, 3]].copy()), want[[0, 3]])


def test_lbl_work_of_a_token(monkeypatch):
    """Noise is drawn without a search for each draw, only symbols and contexts are grouped, usual scores aren't shifted."""
    r, net = toy_model(5)
    text = r.integers(0, 324, 2000)
    needles, members, shifted = [], [], []
    search, groups = np.searchsorted, lbl._Groups
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *x, **k: needles.append(np.size(v)) or search(a, v, *x, **k))
    monkeypatch.setattr(lbl, "_Groups", lambda rows, size: members.append(len(rows)) or groups(rows, size))
    net.fit(text, net.contexts(text, np.array([0, len(text)])), 1)
    assert sum(needles) < len(text) and sum(members) <= len(text) * (lbl.PLACES + 1 + lbl.NOISE[1])

    class Watched(np.ndarray):
        def max(self, axis=None, **k):
            shifted.append(axis)
            return super().max(axis, **k)

    s = r.normal(0, 4, (50, 9)).astype(np.float32)
    assert np.allclose(lbl._log_sum(s.copy().view(Watched)), np.logaddexp.reduce(s, axis=1), atol=1e-5) and 1 not in shifted
    lbl._log_sum((100 * s).view(Watched))
    assert 1 in shifted


def test_lbl_learns_what_follows():
    """Each symbol of the text is followed by one of few; training lifts them far above their shares."""
    r, net = toy_model(2)
    after = r.integers(0, 300, (324, 2))
    text = np.zeros(60_000, np.int64)
    for i in range(1, len(text)):
        text[i] = after[text[i - 1], r.integers(0, 2)]
    context = net.contexts(text, np.array([0, len(text)]))
    before = net.log10(text, context).mean()
    for k in range(3):
        net.fit(text[:50_000], context[:50_000], k)
    assert net.log10(text[50_000:], context[50_000:]).mean() > before + 0.8


def test_lbl_bins():
    n = np.array([0, 1, 2, 3, 4, 5, 6, 300])
    v = lbl.make_vocabulary(np.array([1, 2, 4, 5, 50]), np.array([6, 3, 5, 4, 1]), np.array([7], np.uint64), np.array([50]))
    assert (v.tokens, v.distinct, v.fours) == (102, 19, 0.5)
    sym = v.symbols(np.arange(len(n), dtype=np.uint64), n)
    assert sym[7] == 0 and list(sym[:5]) == [1, 2, 3, 4, 5]
    # the words of a bin share its whole mass
    assert np.isclose(6 * 10 ** v.within(np.array([2]), np.array([1]))[0], 1)
    assert np.isclose(5 * 10 ** v.within(np.array([5]), np.array([4]))[0] + 4 * 10 ** v.within(np.array([5]), np.array([5]))[0], 1)
    assert list(v.left_out(np.array([0, 1, 2, 3, 4, 6]), 1)) == [0, 1, 1, 2, 3, 6]
    assert 400 < (v.left_out(np.full(1000, 5), 1) == 4).sum() < 600


def test_lbl_beats_the_base_on_held_out_text(spark):
    """By known words alone: what it learns of unseen ones is left out of both sums."""
    r = random.Random(7)
    speak = {k: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(80)] for k in "xyz"}
    rows = [(k, " ".join(r.choice(speak["xyz"[k % 3]]) for _ in range(200)), "", "") for k in range(700)]
    got = lbl.score(docs(spark, rows), F.crc32(F.col("doc_id").cast("string")) % 7 == 2).where("held_out and n_known = n_tokens").collect()
    assert len(got) > 50 and sum(x["score"] for x in got) > sum(x["base_score"] for x in got) + 0.2 * sum(x["n_tokens"] for x in got)


def test_lbl_trains_on_every_token(spark, monkeypatch):
    """Over the rounds all tokens of the training documents are targets, and none of the held-out ones."""
    rows = make(16, 120, 60) + EDGES
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    train, seen = lbl._train, []
    monkeypatch.setattr(lbl, "_train", lambda *x: seen.append(train(*x)) or seen[-1])
    got = lbl.score(docs(spark, rows).repartition(3), held, chunk=2000).collect()
    assert sum(seen) == sum(x["n_tokens"] for x in got if not x["held_out"]) == got[0]["train_tokens"]


def test_lbl_sums_by_group():
    r = np.random.default_rng(5)
    for size, rows in ((90, (r.zipf(1.3, 4000) - 1) % 90), (1 << 20, r.integers(0, 1 << 20, 500)), (3, np.array([2]))):
        groups, x = lbl._Groups(rows, size), r.normal(0, 1, (len(rows), 5))
        want, times = np.zeros((size, 5)), np.bincount(rows, minlength=size)
        np.add.at(want, rows, x)
        assert sorted(groups.at) == sorted(set(rows.tolist())) and (groups.times == times[groups.at]).all()
        assert np.allclose(groups.total(x[groups.order]), want[groups.at]) and np.allclose(groups.total(x[groups.order, 0]), want[groups.at, 0])


def _nodes(plan):
    yield plan
    for k in range(plan.children().size()):
        yield from _nodes(plan.children().apply(k))


def test_warc_reads_whole_records_where_they_lie(spark, tmp_path):
    """Only records of several chunks are shuffled; damage is found on either way."""
    r = random.Random(17)
    rows = [(k, f"u{k}", "".join(r.choice("abcdefgh ") for _ in range(n))) for k, n in enumerate([0, 10, 1000, 2999, 3000, 3001, 9000, 20_000] * 4)]
    path = str(tmp_path / "w")
    warc.write(warc.plan(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)), path, chunk_bytes=3000)
    got = warc.read(spark, path)
    assert sorted((x["page_id"], x["payload_digest"]) for x in got.collect()) == [(k, hashlib.sha1(h.encode()).hexdigest()) for k, _, h in rows]
    table = spark.read.parquet(path)
    several = table.where("not (chunk_no = 0 and last)").count()
    assert 0 < several < table.count()
    # what lies below the only exchange is the records of several chunks
    plan = got._jdf.queryExecution().optimizedPlan()
    dealt = [n for n in _nodes(plan) if n.nodeName() in ("RepartitionByExpression", "Repartition")]
    assert len(dealt) == 1
    assert dealt[0].child().nodeName() == "Filter" and "chunk_no" in dealt[0].child().condition().toString()
    one = table.where("chunk_no = 0 and last").limit(1)
    for k, bad in enumerate((table.union(one), table.where("chunk_no <> 1"), table.withColumn("payload_sha1", F.lit("0")))):
        bad.coalesce(1).sortWithinPartitions("archive", "record_no", "chunk_no").write.parquet(str(tmp_path / f"bad{k}"))
        with pytest.raises(Exception, match="record|chunk"):
            warc.read(spark, str(tmp_path / f"bad{k}")).collect()


@pytest.mark.parametrize("given,share", [({}, 0.6), ({"lang": {"en": 3.0, "fr": 1.0, "xx": 5.0}}, 0.9)])
def test_many_cells_are_fitted_like_few(spark, monkeypatch, given, share):
    rows = [(k, "word " * (1 + k % 5 * 7 + k % 3), ("en", "fr", "de")[k % 3], f"s{k % 5}") for k in range(60)] + [(900, None, "fr", "a")]
    key = lambda: sorted(((x["doc_id"], round(x["weight"], 6), round(x["probability"], 6)) for x in mixing.mix(docs(spark, rows), given, 0.5, share, margins=("source", "lang")).collect()), key=str)
    few = key()
    monkeypatch.setattr(mixing, "MAX_CELLS", 2)
    assert key() == few
