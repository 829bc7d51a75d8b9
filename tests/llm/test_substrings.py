import hashlib
import random

import numpy as np
from pyspark.sql import types as T

from siftstone.llm import lpf, substrings


def slow(rows, n=50):
    """(doc_id, text) -> per row: bytes, removed flags."""
    first = {}
    order = lambda d: (d is None, d or 0)
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, t in data:
        for i in range(len(t) - n + 1):
            s = t[i : i + n]
            if s not in first or order(d) < order(first[s]):
                first[s] = d
    out = []
    for d, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if order(first[t[i : i + n]]) < order(d):
                gone[i : i + n] = b"\1" * n
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7))) for _ in range(60)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = [say(r.randrange(5, 30)) for _ in range(12)]
    out = []
    for _ in range(n):
        parts = [say(r.randrange(0, 30)) if r.random() < 0.6 else r.choice(shared)[r.randrange(4) :] for _ in range(r.randrange(0, 7))]
        out.append(" ".join(parts))
        if r.random() < 0.15:
            out.append(r.choice(out))
    out += ["a" * 400, "a" * 49, "a" * 50, "a" * 51, "ab" * 300, "\0" * 120, "\0" * 70 + "x" * 30, "", "x" + "\0" * 60]
    return out


def test_factor_matches_slow():
    r = np.random.default_rng(1)
    for limit in (1, 3, 8, 20, 80):
        for _ in range(20):
            n = int(r.integers(0, 70))
            t, owner = r.integers(0, 2, n).astype(np.uint8), np.sort(r.integers(0, 5, n))
            r.shuffle(owner)
            least = int(r.integers(1, limit + 1))
            got, source = lpf.longest_previous_factor(t, owner, limit, least)
            match = lambda i, j: next((k for k in range(limit) if i + k >= n or j + k >= n or t[i + k] != t[j + k]), limit)
            for i in range(n):
                best = max((match(i, j) for j in range(n) if owner[j] < owner[i]), default=0)
                assert got[i] == (best if best >= least else 0)
                assert source[i] == -1 if not got[i] else owner[source[i]] < owner[i] and match(i, source[i]) >= got[i]


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("part", T.StringType())])


def check(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(5)
    got = substrings.dedup(df, **options).collect()
    assert sorted((tuple(x)[:5] for x in got), key=str) == slow(rows)


def test_dedup_matches_slow(spark):
    ids = list(range(400))
    random.Random(2).shuffle(ids)
    rows = list(zip(ids, texts(3, 120)))
    rows += [(rows[5][0], rows[5][1]), (rows[7][0], rows[8][1]), (None, rows[3][1]), (None, rows[3][1] + "z" * 60), (900, None)]
    check(spark, rows)
    check(spark, rows, chunk=3000, hot=2)


def test_many_rows_without_an_identifier(spark):
    """They are one document each of whose texts is known apart; a string that all share goes if an earlier one has it."""
    r = random.Random(4)
    say = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    shared = say(120)
    check(spark, [(None, say(r.randrange(40)) + (shared if k % 2 else "") + say(60)) for k in range(2500)] + [(1, say(30) + shared)])


def test_an_anchor_with_many_contexts(spark):
    """A short string with other surroundings in every document, which some of them share."""
    r = random.Random(5)
    say = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    short, around = "0123456789" * 3, [(say(40), say(40)) for _ in range(8)]
    rows = [(k, say(30) + a + short + b + say(30)) for k in range(150) for a, b in [r.choice(around) if r.random() < 0.3 else (say(40), say(40))]]
    check(spark, rows)
    check(spark, rows, chunk=3000, hot=20)


def test_dedup_empty(spark):
    assert substrings.dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    check(spark, [(1, ""), (2, None), (3, "short")])
