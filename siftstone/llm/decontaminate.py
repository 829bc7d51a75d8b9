"""Benchmark decontamination over a distributed positional inverted index of the training documents.

The index is cut by document into shards of bounded size. For each shard and term it holds the posting list of the
term: the positions, counted through the shard with a gap between documents, so that no match can cross one. A phrase
is found by intersecting offset-adjusted lists from its rarest term on; the rarest is judged by counts over the whole
corpus. Nothing is looked up by scanning a text again.

Terms are those that the benchmark uses (or all, if asked); its size is checked, and a benchmark over the limit is
searched block by block against all shards.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, compress, each, expand, lean, stage

#: Bytes that separate words: all of ASCII but digits and letters
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
WINDOW = 13
#: Positions between the documents of a shard; wider than any window or proximity span
GAP = 1 << 12
SHARD_BYTES = 8 << 20
#: Words of benchmark windows searched at once
BLOCK_WORDS = 4_000_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def windows(item: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Runs of width words; an item of fewer, but not none, is one window."""
    if not item:
        return []
    return [tuple(item[i : i + width]) for i in range(max(1, len(item) - width + 1))]


def build_index(docs: DataFrame, terms: set[bytes] | None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard, term, n, postings), and for each shard a row without term whose postings are its documents.

    terms None: every term of the corpus. A posting list is a compressed array of position differences. A shard is
    named by the numbers of its partition and of its chunk there, which no other has, whatever its rows hold.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in enumerate(chunked(batches, "text", shard_bytes)):
            ids: dict[bytes, int] = {t: i for i, t in enumerate(sorted(terms))} if terms is not None else {}
            found, sizes = [], []
            base = 0
            for text in each(table.column("text")):
                w = words(text)
                if terms is None:
                    codes = np.fromiter((ids.setdefault(x, len(ids)) for x in w), np.int64, len(w))
                else:
                    codes = np.fromiter(map(ids.get, w, (-1,) * len(w)), np.int64, len(w))
                at = np.flatnonzero(codes >= 0)
                found.append((codes[at], at + base))
                sizes.append(len(w))
                base += len(w) + GAP
            codes = np.concatenate([x for x, _ in found])
            at = np.concatenate([x for _, x in found])
            order = np.argsort(codes, kind="stable")
            codes, at = codes[order], at[order]
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.empty(0, np.int64)
            ends = np.r_[starts[1:], len(codes)].astype(np.int64)
            names = list(ids)
            id_col = table.column("doc_id").combine_chunks().cast(pa.int64())
            key = f"{table.column('part')[0].as_py()}-{number}"
            head = pa.record_batch([id_col, pa.array(sizes, pa.int64())], names=["doc_id", "n"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as out:
                out.write_batch(head)
            term = [None, *(names[codes[s]] for s in starts)]
            post = [compress(sink.getvalue().to_pybytes()), *(_encode(at[s:e]) for s, e in zip(starts, ends))]
            yield pa.record_batch(
                [pa.array([key] * len(term)), pa.array(term, pa.binary()), pa.array([len(sizes), *(ends - starts).tolist()], pa.int64()), pa.array(post, pa.binary())],
                names=["shard", "term", "n", "postings"],
            )

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text", "spark_partition_id() as part").mapInArrow(lean(run), "shard string, term binary, n bigint, postings binary")


def _encode(at: np.ndarray) -> bytes:
    return compress(np.diff(at, prepend=0).astype(np.uint32).tobytes(), 1)


def _decode(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(expand(data), np.uint32).astype(np.int64))


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x if len(sorted_values) else np.zeros(len(x), bool)


def phrase_starts(postings, phrase: tuple[bytes, ...], rank: dict[bytes, int]) -> np.ndarray:
    """Start positions of the phrase: postings(term) are intersected from the rarest term of the corpus on."""
    order = sorted(range(len(phrase)), key=lambda i: (rank.get(phrase[i], 0), i))
    starts = None
    for i in order:
        at = postings(phrase[i])
        if at is None:
            return np.empty(0, np.int64)
        starts = at - i if starts is None else starts[_member(at, starts + i)]
        if not len(starts):
            break
    return starts


def proximity_starts(postings, terms: tuple[bytes, ...], slop: int, rank: dict[bytes, int]) -> np.ndarray:
    """Positions of the rarest term with every other term at most slop words away, in any order."""
    order = sorted(set(terms), key=lambda t: (rank.get(t, 0), t))
    near = postings(order[0])
    if near is None:
        return np.empty(0, np.int64)
    for t in order[1:]:
        at = postings(t)
        if at is None:
            return np.empty(0, np.int64)
        near = near[np.searchsorted(at, near + slop, "right") > np.searchsorted(at, near - slop, "left")]
    return near


def frequencies(index: DataFrame) -> DataFrame:
    """(term, n): occurrences over the whole corpus."""
    return index.where("term is not null").groupBy("term").agg(F.sum("n").alias("n"))


class _Shard:
    """The documents and posting lists of one shard, and what a plan's phrases find in them."""

    def __init__(self, table: pa.Table) -> None:
        self.blobs = dict(zip(table.column("term").to_pylist(), table.column("postings").to_pylist()))
        self.docs = pa.ipc.open_stream(expand(self.blobs.pop(None))).read_all()
        self.sizes = self.docs.column("n").to_numpy()
        self.bases = np.r_[0, np.cumsum(self.sizes + GAP)[:-1]].astype(np.int64)
        self.cache: dict[bytes, np.ndarray | None] = {}

    def postings(self, term: bytes) -> np.ndarray | None:
        if term not in self.cache:
            data = self.blobs.get(term)
            self.cache[term] = None if data is None else _decode(data)
        return self.cache[term]

    def hits(self, plan: list, by_rarest: dict[bytes, list[int]], rank: dict[bytes, int], slop: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number in the plan, rows, starts) of the phrases that occur: only those whose rarest term the shard holds are sought."""
        for term in sorted(self.blobs.keys() & by_rarest.keys()):
            for k in by_rarest[term]:
                phrase = plan[k][0]
                at = phrase_starts(self.postings, phrase, rank) if slop is None else proximity_starts(self.postings, phrase, slop, rank)
                if len(at):
                    row = np.searchsorted(self.bases, at, "right") - 1
                    yield k, row, at - self.bases[row]


def _rarest(plan: list, rank: dict[bytes, int]) -> dict[bytes, list[int]]:
    """The phrases of a plan by their rarest term; one with a term that the corpus lacks occurs nowhere."""
    out: dict[bytes, list[int]] = defaultdict(list)
    for k, (phrase, _) in enumerate(plan):
        if all(t in rank for t in phrase):
            out[min(phrase, key=lambda t: rank[t])].append(k)
    return dict(out)


HITS = "shard string, row bigint, doc_id bigint, n_words bigint, start bigint, length bigint, item_ids array<bigint>"


def _search(index: DataFrame, plan: list[tuple[tuple[bytes, ...], tuple]], rank: dict[bytes, int], slop: int | None) -> DataFrame:
    """HITS of a plan: phrases with what they belong to; and for each document a row with start -1."""
    by_rarest = _rarest(plan, rank)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = _Shard(table)
        n = len(shard.sizes)
        rows, starts, lengths, items = [np.arange(n)], [np.full(n, -1)], [np.zeros(n, np.int64)], [[]] * n
        for k, row, start in shard.hits(plan, by_rarest, rank, slop):
            rows.append(row)
            starts.append(start)
            lengths.append(np.full(len(row), len(plan[k][0]) if slop is None else 1))
            items += [list(plan[k][1])] * len(row)
        which = np.concatenate(rows)
        return pa.table(
            {
                "shard": pa.array([key[0].as_py()] * len(which), pa.string()),
                "row": pa.array(which, pa.int64()),
                "doc_id": shard.docs.column("doc_id").combine_chunks().take(pa.array(which)),
                "n_words": pa.array(shard.sizes[which].astype(np.int64)),
                "start": pa.array(np.concatenate(starts), pa.int64()),
                "length": pa.array(np.concatenate(lengths), pa.int64()),
                "item_ids": pa.array(items, pa.list_(pa.int64())),
            }
        )

    return index.groupBy("shard").applyInArrow(run, HITS)


COVER = "shard string, row bigint, doc_id bigint, n_words bigint, starts array<bigint>, ends array<bigint>, item_ids array<bigint>"


def _cover(index: DataFrame, plan: list[tuple[tuple[bytes, ...], tuple]], rank: dict[bytes, int]) -> DataFrame:
    """COVER: a row for each document, with the merged spans of its hit words and the items that they belong to."""
    by_rarest = _rarest(plan, rank)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = _Shard(table)
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[int]] = defaultdict(set)
        for k, row, start in shard.hits(plan, by_rarest, rank, None):
            width = len(plan[k][0])
            for d, s in zip(row.tolist(), start.tolist()):
                spans[d].append((s, s + width))
            for d in np.unique(row).tolist():
                items[d].update(plan[k][1])
        n = len(shard.sizes)
        merged = [_merged(spans[d]) if d in spans else [] for d in range(n)]
        many = pa.list_(pa.int64())
        return pa.table(
            {
                "shard": pa.array([key[0].as_py()] * n, pa.string()),
                "row": pa.array(np.arange(n), pa.int64()),
                "doc_id": shard.docs.column("doc_id").combine_chunks(),
                "n_words": pa.array(shard.sizes.astype(np.int64)),
                "starts": pa.array([[s for s, _ in x] for x in merged], many),
                "ends": pa.array([[e for _, e in x] for x in merged], many),
                "item_ids": pa.array([sorted(items.get(d, ())) for d in range(n)], many),
            }
        )

    return index.groupBy("shard").applyInArrow(run, COVER)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _plans(benchmark: DataFrame, width: int, block_words: int) -> Iterator[list[tuple[tuple[bytes, ...], tuple]]]:
    """The windows of the benchmark with the items they come from, in blocks of at most about block_words words."""
    held: dict[tuple[bytes, ...], set] = defaultdict(set)
    size = 0
    for r in benchmark.selectExpr("cast(item_id as bigint) as item_id", "text").toLocalIterator():
        for w in windows(words(r["text"]), width):
            if w not in held:
                size += len(w)
            held[w].add(r["item_id"])
        if size >= block_words:
            yield [(w, tuple(i for i in ids if i is not None)) for w, ids in sorted(held.items())]
            held, size = defaultdict(set), 0
    if held:
        yield [(w, tuple(i for i in ids if i is not None)) for w, ids in sorted(held.items())]


def _blocks(docs: DataFrame, benchmark: DataFrame, width: int, block_words: int, shard_bytes: int) -> Iterator[tuple[DataFrame, list, dict[bytes, int]]]:
    """(index of the terms, plan, ranks of the terms) of each block of the benchmark; once without phrases if it has none."""
    plans = _plans(benchmark, width, block_words)
    ahead = list(itertools.islice(plans, 2))
    if len(ahead) > 1:
        # written down, so that the shards of all blocks are cut alike
        docs = stage(docs.select("doc_id", "text"), "documents")
    for plan in itertools.chain(ahead or [[]], plans):
        index = stage(build_index(docs, {t for w, _ in plan for t in w}, shard_bytes), "postings")
        counts = sorted(((r["n"], bytes(r["term"])) for r in frequencies(index).toLocalIterator())) if plan else []
        yield index, plan, {t: i for i, (_, t) in enumerate(counts)}


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int | None = None, block_words: int = BLOCK_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All occurrences of the benchmark's windows, and for each document one row with start -1.

    Columns: shard and row (which name a row of docs), doc_id, n_words, start (word), length, item_ids. slop: instead
    of exact phrases, places where all words of a window stand within slop words of its rarest one.
    """
    out = None
    for index, plan, rank in _blocks(docs, benchmark, width, block_words, shard_bytes):
        found = _search(index, plan, rank, slop)
        out = found if out is None else out.unionByName(found.where("start >= 0"))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, parts: int = 20, block_words: int = BLOCK_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, item_ids, contaminated.

    A word inside any occurrence of a window is hit; contaminated if at least one word in parts is. Null and empty
    texts have no words and aren't contaminated; items without words have no window. An item_id that is null hits but
    isn't listed; repeated items are one. Repeated rows and null doc_ids are judged row by row. Empty tables give no
    rows, or no hits. Only doc_id, item_id and text are read.
    """
    covers = [_cover(*block) for block in _blocks(docs, benchmark, width, block_words, shard_bytes)]
    if len(covers) == 1:
        return _counted(covers[0], parts)
    rows = covers[0]
    for x in covers[1:]:
        rows = rows.union(x.where(F.size("starts") > 0))
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "item_ids")]
    # a document has a row for each block that hits it
    joined = rows.groupBy("shard", "row").agg(F.min("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *lists)
    return _counted(joined.select("shard", "row", "doc_id", "n_words", "starts", "ends", "item_ids"), parts)


def _counted(covers: DataFrame, parts: int) -> DataFrame:
    spans = F.array_sort(F.arrays_zip("starts", "ends"))
    start = F.struct(F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("upto"))

    def step(acc, x):
        new = F.greatest(F.lit(0).cast("bigint"), x["ends"] - F.greatest(acc["upto"], x["starts"]))
        return F.struct((acc["hit"] + new).alias("hit"), F.greatest(acc["upto"], x["ends"]).alias("upto"))

    out = covers.select("doc_id", "n_words", F.aggregate(spans, start, step)["hit"].alias("n_hit"), F.array_sort(F.array_distinct("item_ids")).alias("item_ids"))
    flag = (F.col("n_hit") > 0) & (parts * F.col("n_hit") >= F.col("n_words"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), "item_ids", flag.alias("contaminated"))
