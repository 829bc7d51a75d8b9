"""The pipeline against a plain version of each stage, on a small corpus with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

from siftstone.llm import langid, mixing, simhash

from .test_operators import DOCS, slow_exact, slow_hits
from .test_shingles import slow_links, slow_set
from .test_simhash import slow_components

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def corpus():
    r = random.Random(11)
    speak = {"en": ["the", "of", "thing", "ther", "ation", "was", "ing"], "de": ["der", "und", "ung", "schen", "keit", "ist", "ein"]}
    say = lambda lang, n: " ".join(r.choice(speak[lang]) + r.choice(["", "en", "s", "a", "o"]) + r.choice(["", "x", "y"]) for _ in range(n))
    rows = [(k, say(lang, r.randrange(30, 300)), lang, r.choice(["a", "a", "b"]), None) for k in range(60) for lang in [r.choice(["en", "de"])]]
    items = [(k, say("en", 30)) for k in range(4)]
    rows.append((70, rows[3][1].replace(" ", "\n"), "en", "a", None))
    rows.append((71, rows[4][1] + "  ", "en", "b", None))
    longest = max(rows, key=lambda x: len(x[1]))
    rows.append((72, longest[1] + " end", longest[2], "a", None))
    rows.append((77, say("en", 900) + " " + items[2][1] + " " + say("en", 900), "en", "a", None))
    rows.append((73, say("en", 20) + " " + items[1][1] + " " + say("en", 20), "en", "a", None))
    rows += [(74, None, "en", "a", None), (75, "", "de", None, None), (76, " 12 ", None, "a", None)]
    return rows, items


def plain(spark, rows, items):
    """doc_ids after each stage but the last."""
    df = spark.createDataFrame([(*x, "d", "k", "s") for x in rows], DOCS)
    model = tuple(sorted(langid.learn(df).items()))
    left = [x for x in rows if not langid.predict(x[1], model)[3]]
    out = [{x[0] for x in left}]
    kept = {d for d, _, _, keep, _ in slow_exact(left) if keep}  # no doc_id comes twice here
    left = [x for x in left if x[0] in kept]
    out.append({x[0] for x in left})
    near = slow_components((left[a][0], left[b][0]) for a, b in slow_links([x[1] for x in left]))
    left = [x for x in left if near.get(x[0], x[0]) == x[0]]
    out.append({x[0] for x in left})
    bad = {d for d, _, hit, *_ in slow_hits(left, items) if hit}
    left = [x for x in left if x[0] not in bad]
    out.append({x[0] for x in left})
    return out, left


def test_pipeline(spark, tmp_path):
    rows, items = corpus()
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    frame = lambda x: spark.createDataFrame([(*r, "d", "k", "s") for r in x], DOCS).select(names)
    frame(rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want, left = plain(spark, rows, items)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        if k < 4:
            assert docs.columns == names
            assert {r["doc_id"] for r in docs.collect()} == want[k], name
    assert want[0] >= {70, 73} and not want[0] & {74, 75, 76}
    assert not want[1] & {70, 71} - {71} or len(want[0] - want[1]) == 2
    assert {73, 77} <= want[2] and not {73, 77} & want[3]
    sampled = {r["doc_id"] for r in mixing.mix(frame(left), mixing.TARGETS).where(F.col("sampled")).collect()}
    assert {r["doc_id"] for r in docs.collect()} == sampled
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))
    empty = str(tmp_path / "empty")
    frame(rows).limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []


@pytest.mark.parametrize("name", ["exact_dedup", "near_dedup", "decontamination"])
def test_rows_are_judged_one_by_one(spark, tmp_path, name):
    """Rows with a null or repeated doc_id stay or go by their own text, and of equal rows one stays."""
    r = random.Random(13)
    say = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    item, clean = say(30), [say(120) for _ in range(6)]
    bad = say(60) + " " + item
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    gone = {
        "exact_dedup": [(None, clean[3]), (5, clean[2]), (3, clean[3]), (3, clean[3])],
        "near_dedup": [(None, clean[3] + " x"), (5, clean[2] + " x"), (3, clean[3] + " y")],
        "decontamination": [(None, bad), (5, bad), (5, bad)],
    }[name]
    kept = [(None, clean[0]), (None, clean[1]), (1, clean[2]), (2, clean[3]), (5, clean[4]), (3, clean[5])]
    frame = spark.createDataFrame([(d, t, "en", "a", None) for d, t in gone + kept], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = dict(corpus_pipeline.STAGES)[name](spark, frame.repartition(3), str(tmp_path))
    assert got.columns == frame.columns
    assert sorted(((x["doc_id"], x["text"]) for x in got.collect()), key=str) == sorted(kept, key=str)


def test_near_copies_by_fingerprint_or_similarity(spark, tmp_path):
    """Links of fingerprints count where the sets of shingles differ, links of sets where fingerprints do, and both join."""
    r = random.Random(22)
    say = lambda n: " ".join(f"v{r.randrange(10**6)}" for _ in range(n))
    again = (say(11) + " ") * 100
    first, second = (again + say(40) for _ in range(2))
    third = second + " " + say(8)
    alike = say(100)
    copies = {1: first, 2: second, 3: third, 4: alike, 5: alike + " " + say(12)}
    fp = {k: simhash.fingerprint(t) for k, t in copies.items()}
    jaccard = lambda a, b: len(slow_set(copies[a]) & slow_set(copies[b])) / len(slow_set(copies[a]) | slow_set(copies[b]))
    assert (fp[1] ^ fp[2]).bit_count() <= 4 and jaccard(1, 2) < 0.8
    assert (fp[4] ^ fp[5]).bit_count() > 4 and jaccard(4, 5) >= 0.8
    rows = [*copies.items(), *((k, say(120)) for k in range(6, 12))]
    frame = spark.createDataFrame([(d, t, "en", "a", None) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.near_duplicates(spark, frame.repartition(3), str(tmp_path)).collect()
    assert sorted(x["doc_id"] for x in got) == [1, 4, *range(6, 12)]
