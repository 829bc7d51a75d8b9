import random

import numpy as np
import pytest

from siftstone.llm import shingles

from .test_simhash import slow_components

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def slow_set(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def slow_links(rows):
    sets = [slow_set(t) for t in rows]
    return [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def texts():
    """Copies with words replaced, on both sides of 0.8; a passage that many share; chains; short, empty and null texts."""
    r = random.Random(21)
    say = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    shared, out = say(60), []
    for _ in range(25):
        base = say(r.randrange(40, 400)) + (shared if r.random() < 0.5 else [])
        out.append(" ".join(base))
        for _ in range(r.randrange(5)):
            copy = list(base)
            for _ in range(r.randrange(1, max(2, len(copy) // 25))):
                copy[r.randrange(len(copy))] = "z" + str(r.randrange(10**6))
            out.append(" ".join(copy))
            if r.random() < 0.4:
                base = copy
    out += [" ".join(shared)] * 3 + ["one two", "One  TWO", "one two three", "", None, " \n", "a b c d e"] + ["same " * 50, "same " * 70]
    return out


@pytest.mark.parametrize("common,few,block", [(0, 16, 2048), (1 << 19, 2, 3)])
def test_all_similar_pairs_are_linked(spark, monkeypatch, common, few, block):
    monkeypatch.setattr(shingles, "COMMON", common)
    monkeypatch.setattr(shingles, "FEW", few)
    monkeypatch.setattr(shingles, "BLOCK", block)
    rows = texts()
    pairs = slow_links(rows)
    assert len(pairs) > 30
    df = spark.createDataFrame(list(enumerate(rows)), "id bigint, text string").repartition(3)
    got = {x["id"]: x["root"] for x in shingles.near_components(df).collect()}
    assert got == slow_components(pairs)
    assert shingles.near_components(df.limit(0)).collect() == []


def test_parities_never_exceed_the_difference():
    r = random.Random(3)
    for _ in range(200):
        a = {r.randrange(1 << 63) for _ in range(r.randrange(1, 400))}
        b = set(r.sample(sorted(a), r.randrange(len(a) + 1))) | {r.randrange(1 << 63) for _ in range(r.randrange(1, 300))}
        x, y = (shingles.parities(np.array(sorted(s), np.uint64)) for s in (a, b))
        assert shingles.least_difference(x, y) <= len(a ^ b)
    assert shingles.least_difference(x, x) == 0


def test_a_group_of_near_copies(spark):
    """Copies of one text, on both sides of 0.8 to it and to each other: links that only a few of them have are found."""
    r = random.Random(6)
    base = [f"w{r.randrange(900)}" for _ in range(120)]
    rows = [" ".join("z" + str(r.randrange(40)) if r.random() < p else w for w in base) for p in (0.005, 0.02, 0.03, 0.04) for _ in range(60)]
    pairs = slow_links(rows)
    got = {x["id"]: x["root"] for x in shingles.near_components(spark.createDataFrame(list(enumerate(rows)), "id bigint, text string").repartition(3)).collect()}
    assert got == slow_components(pairs) and 60 < len(got) < 240


def test_pipeline_drops_copies_at_the_threshold(spark):
    """Fingerprints of such copies differ in more than four bits; one row in each component stays."""
    rows = texts()
    root = slow_components(slow_links(rows))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(3)
    got = {x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert got == {k for k in range(len(rows)) if root.get(k, k) == k}
