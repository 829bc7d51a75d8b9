import random

import xxhash
from pyspark.sql import types as T

from siftstone.llm import simhash
from siftstone.llm.components import components


def slow_fingerprint(text, width=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def slow_components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_fingerprint_matches_slow():
    for t in (None, "", " \n", "One", "a b c", "A b c d e F g", "é É ß one two\tthree four five " * 40, "x" * 5000):
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = slow_components(p for p in pairs if p[0] != p[1])
    assert got == want


def _brute(spark, fps):
    return slow_components((a, b) for a in fps for b in fps if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4)


def test_links_are_whole(spark):
    r = random.Random(9)
    fps = {0, -1}
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(14):
            x = base
            for b in r.sample(range(64), r.randrange(7)):
                x ^= 1 << b
            fps.add(x - (1 << 64) if x >> 63 else x)
    nodes = spark.createDataFrame([(f, f) for f in fps], "fp bigint, root bigint")
    want = {(min(a, b), max(a, b)) for a in fps for b in fps if a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    for refine in (False, True):
        got = [(x.a, x.b) for x in simhash.links(nodes, refine).collect()]
        assert {(min(p), max(p)) for p in got} == want
    near = simhash.close_classes(nodes.select("fp")).collect()
    assert {(min(x.a, x.b), max(x.a, x.b)) for x in near} <= want


def test_near_dedup_edges(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base, "x"), (3, base + " tail", None), (9, None, None), (8, "", "y"), (8, "", "y"), (None, base, None), (1, "other words here now then", None)]
    got = sorted(((x.doc_id, x.component_id) for x in simhash.near_dedup(spark.createDataFrame(rows, schema)).collect()), key=str)
    texts = {d: simhash.fingerprint(t) for d, t, _ in rows}
    same = bin(texts[5] ^ texts[3]).count("1") <= 4
    first = 3 if same else 5
    assert got == sorted([(5, first), (3, 3), (9, 8), (8, 8), (8, 8), (None, first), (1, 1)], key=str)
    assert simhash.near_dedup(spark.createDataFrame([], schema)).collect() == []
