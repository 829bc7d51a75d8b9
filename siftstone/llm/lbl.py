"""LM scoring with a log-bilinear model.

Each task reads a chunk of documents, numbers its distinct words and counts them; the counts are dealt by hash, added
up, and come back to the chunk, so every word of the corpus is counted exactly and no text is shuffled. The most
frequent words are symbols of their own; the others are binned by how often they occur, and within a bin a word has its
share of the bin's occurrences. Unseen words are the bin of count 0 and one event, as in the base: both are probabilities
over the words that were seen and one that stands for all others. What it takes to say which unseen word it was, if
they are as many as the seen ones and one, is left to a column of its own.

The model predicts a symbol from the four before it: their vectors, each weighted by its place, add up to a predicted
vector, and its products with the symbols' vectors are the scores. Symbols are dealt into classes, and the class is
predicted before the symbol within it, so that batched matrix products give exactly normalised probabilities. Both
steps are trained in numpy by noise-contrastive estimation: each task trains on its own share of the training tokens
and the changes are averaged, some rounds in succession. Every training token is a target once, in one of the rounds.

Words are held by 64-bit hashes: two words of the same hash would be counted as one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, chunked, compress, expand, stage, text_bytes

#: Hash of the end token; a word that had it would be counted as an end
END = np.uint64(0)
#: Words that are symbols of their own, at most, and how often each must occur
VOCABULARY, LEAST = 1 << 15, 8
#: Bins of the other words by count, and classes of symbols (the last one holds the bins)
BINS, CLASSES = 24, 128
VECTOR, PLACES = 24, 4
#: Training: noise draws are for classes (of a batch) and symbols (of a position)
ROUNDS, BATCH, NOISE, RATE, START = 3, 4096, (32, 4), 0.08, 1e-3
#: Targets of a round that one task trains on, about: fewer would be noise more than anything
TARGETS = 2_000_000
CHUNK = 8 << 20
#: Tokens that are scored at once, and rows of class scores
TOGETHER, CACHED = 1 << 17, 2048


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def hashes(text: str | None) -> np.ndarray:
    """The tokens of a text: its words and one end."""
    f = xxhash.xxh64_intdigest
    w = words(text)
    out = np.empty(len(w) + 1, np.uint64)
    out[:-1] = [f(x) for x in w]
    out[-1] = END
    return out


def count_bin(c: np.ndarray) -> np.ndarray:
    """Bin of words that aren't in the vocabulary, by count: 0, 1, 2, 3, then by thirds of octaves."""
    low = np.minimum(c, 3)
    high = 4 + np.floor(3 * np.log2(np.maximum(c, 4) / 4)).astype(np.int64)
    return np.where(c < 4, low, np.minimum(high, BINS - 1))


@dataclass(frozen=True)
class Vocabulary:
    """tokens, distinct: of the training documents. known: sorted hashes of the vocabulary, rank: the symbol of each."""

    tokens: int
    distinct: int
    known: np.ndarray
    rank: np.ndarray
    #: training tokens of each symbol: the vocabulary's from the most frequent on, then the bins'
    mass: np.ndarray
    #: of the training tokens in bin 4 those whose word occurs four times
    fours: float

    @property
    def size(self) -> int:
        return len(self.mass)

    def symbols(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = len(self.known) + count_bin(c)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            out = np.where(self.known[at] == h, self.rank[at], out)
        return out

    def within(self, sym: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its symbol, which for a bin is that of the bin's occurrences."""
        share = np.zeros(len(sym))
        seen = (sym >= len(self.known)) & (c > 0)
        share[seen] = np.log10(c[seen] / self.mass[sym[seen]])
        return share

    def left_out(self, sym: np.ndarray, seed: int) -> np.ndarray:
        """Symbols of training tokens as they would be if their own occurrence had not been counted.

        So unseen words have a probability. Of bin 4 that holds for words of count 4, drawn by their share.
        """
        n = len(self.known)
        bin_ = sym - n
        drop = (bin_ >= 1) & (bin_ <= 3)
        four = np.flatnonzero(bin_ == 4)
        drop[four[np.random.default_rng(seed).random(len(four)) < self.fours]] = True
        return sym - drop


# counting


def _pack(u: np.ndarray, n: np.ndarray) -> bytes:
    # counts are one byte but for a few, which follow with their places
    big = np.flatnonzero(n >= 255)
    small = np.minimum(n, 255).astype(np.uint8)
    return compress(struct.pack("<qq", len(u), len(big)) + np.diff(u, prepend=np.uint64(0)).astype("<u8").tobytes() + small.tobytes() + big.astype("<u4").tobytes() + n[big].astype("<u8").tobytes(), 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = expand(blob)
    n, b = struct.unpack_from("<qq", data)
    u = np.cumsum(np.frombuffer(data, "<u8", n, 16), dtype=np.uint64)
    c = np.frombuffer(data, "u1", n, 16 + 8 * n).astype(np.uint64)
    c[np.frombuffer(data, "<u4", b, 16 + 9 * n)] = np.frombuffer(data, "<u8", b, 16 + 9 * n + 4 * b)
    return u, c


READ = "chunk string, part int, blob binary, doc_id array<bigint>, held_out array<boolean>, sizes array<bigint>"


def _read(docs: DataFrame, parts: int, chunk: int) -> DataFrame:
    """For each chunk of documents a row of each part with its distinct words and training counts, and one without part.

    That one holds the documents: identifiers, numbers of tokens, and for each token the number of its word among the
    chunk's, which are in order.
    """
    schema = pa.schema([("chunk", pa.string()), ("part", pa.int32()), ("blob", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in enumerate(chunked(batches, "text", chunk)):
            tokens = [hashes(x) for x in table.column("text").to_pylist()]
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            held = np.asarray(table.column("held_out").to_pylist(), bool)
            u, at = np.unique(np.concatenate(tokens), return_inverse=True)
            n = np.bincount(at, np.repeat(~held, sizes), len(u)).astype(np.uint64)
            part = (u % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
            rows = [(int(part[order[s]]), _pack(u[order[s:e]], n[order[s:e]])) for s, e in zip(cuts, [*cuts[1:], len(order)])]
            name = f"{table.column('part')[0].as_py()}-{number}"
            k = len(rows)
            yield pa.record_batch(
                [
                    pa.array([name] * (k + 1)),
                    pa.array([p for p, _ in rows] + [None], pa.int32()),
                    pa.array([b for _, b in rows] + [compress(at.astype("<u4").tobytes(), 1)], pa.binary()),
                    pa.array([None] * k + [table.column("doc_id").to_pylist()], schema.field("doc_id").type),
                    pa.array([None] * k + [held.tolist()], schema.field("held_out").type),
                    pa.array([None] * k + [sizes.tolist()], schema.field("sizes").type),
                ],
                schema=schema,
            )

    return docs.select("text", "doc_id", "held_out", F.spark_partition_id().alias("part")).mapInArrow(run, READ)


STATS = "kind string, chunk string, blob binary"


def _total(counted: DataFrame, keep: int) -> DataFrame:
    """By part: for each chunk its words and their counts over the corpus; a row of counts of counts; the most frequent words."""

    def run(table: pa.Table) -> pa.Table:
        got = [_unpack(b) for b in table.column("blob").to_pylist()]
        u, at = np.unique(np.concatenate([x for x, _ in got]), return_inverse=True)
        c = np.bincount(at, np.concatenate([n for _, n in got]), len(u)).astype(np.uint64)
        rows = []
        start = 0
        for chunk, (x, _) in zip(table.column("chunk").to_pylist(), got):
            rows.append(("counts", chunk, _pack(x, c[at[start : start + len(x)]])))
            start += len(x)
        seen = c > 0
        often = np.flatnonzero(c >= LEAST)
        top = often[np.lexsort((u[often], -c[often].astype(np.int64)))[:keep]]
        values, times = np.unique(c[seen], return_counts=True)
        rows.append(("values", None, _pack_pairs(values, times)))
        rows.append(("top", None, _pack_pairs(u[top], c[top])))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))], names=["kind", "chunk", "blob"])

    return counted.groupBy("part").applyInArrow(run, STATS)


def _pack_pairs(keys: np.ndarray, values: np.ndarray) -> bytes:
    return compress(struct.pack("<q", len(keys)) + keys.astype("<u8").tobytes() + values.astype("<u8").tobytes())


def _pairs(blobs: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, values = [], []
    for b in blobs:
        data = expand(b)
        n = struct.unpack_from("<q", data)[0]
        keys.append(np.frombuffer(data, "<u8", n, 8))
        values.append(np.frombuffer(data, "<u8", n, 8 + 8 * n))
    return (np.concatenate(keys), np.concatenate(values)) if keys else (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _merged_pairs(rows: DataFrame, kind: str, groups: int, best: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (key, number) pairs, or the best by number, merged by groups of parts before the driver has them."""

    def run(table: pa.Table) -> pa.Table:
        blob = _pack_pairs(*_join(*_pairs(table.column("blob").to_pylist()), best))
        return pa.table([pa.array([blob], pa.binary())], names=["blob"])

    some = rows.where(F.col("kind") == kind).withColumn("g", F.pmod(F.hash(F.monotonically_increasing_id()), F.lit(groups)))
    got = some.select("g", "blob").groupBy("g").applyInArrow(run, "blob binary").toLocalIterator()
    return _join(*_pairs(bytes(r["blob"]) for r in got), best)


def _join(keys: np.ndarray, values: np.ndarray, best: int | None) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(keys, return_inverse=True)
    n = np.zeros(len(u), np.uint64)
    np.add.at(n, at, values)
    if best is not None:
        order = np.lexsort((u, -n.astype(np.int64)))[:best]
        u, n = u[order], n[order]
    return u, n


def vocabulary(stats: DataFrame, groups: int, size: int) -> Vocabulary:
    values, times = _merged_pairs(stats, "values", groups)
    top, top_n = _merged_pairs(stats, "top", groups, size)
    return make_vocabulary(values.astype(np.int64), times.astype(np.int64), top, top_n.astype(np.int64))


def make_vocabulary(values: np.ndarray, times: np.ndarray, top: np.ndarray, top_n: np.ndarray) -> Vocabulary:
    """values, times: counts of counts of all words; top, top_n: hashes and counts of the vocabulary, most frequent first."""
    mass = np.zeros(BINS)
    np.add.at(mass, count_bin(values), (values * times).astype(float))
    np.subtract.at(mass, count_bin(top_n), top_n.astype(float))
    rest = dict(zip(values.tolist(), times.tolist()))
    four = 4 * rest.get(4, 0)
    order = np.argsort(top)
    return Vocabulary(int((values * times).sum()), int(times.sum()), top[order], order.astype(np.int64), np.r_[top_n, mass], four / mass[4] if mass[4] > 0 else 0.0)


TEXTS = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, within double, symbols binary, share int"


def _classify(read: DataFrame, counts: DataFrame, v: Vocabulary) -> DataFrame:
    """A row for each document: its numbers, and its symbols. share: the round of training that the chunk belongs to."""
    logs = np.log10(v.tokens + v.distinct + 1)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("within", pa.float64()), ("symbols", pa.binary()), ("share", pa.int32())])
    width = "<u2" if v.size < 1 << 16 else "<u4"

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        row = left.to_pylist()[0]
        at = np.frombuffer(expand(row["blob"]), "<u4").astype(np.int64)
        offsets = np.r_[0, np.cumsum(row["sizes"])].astype(np.int64)
        got = [_unpack(b) for b in right.column("blob").to_pylist()]
        u, n = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(u)
        u, n = u[order], n[order].astype(np.int64)
        sym = v.symbols(u, n)
        share = np.add.reduceat(v.within(sym, n)[at], offsets[:-1])
        base = np.add.reduceat((np.log10(n + 1.0) - logs)[at], offsets[:-1])
        known = np.add.reduceat((n > 0).astype(np.int64)[at], offsets[:-1])
        symbols = sym.astype(width)[at]
        size = len(row["sizes"])
        return pa.table(
            {
                "doc_id": pa.array(row["doc_id"], pa.int64()),
                "held_out": pa.array(row["held_out"], pa.bool_()),
                "n_tokens": pa.array(row["sizes"], pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "within": pa.array(share, pa.float64()),
                "symbols": pa.array([symbols[s:e].tobytes() for s, e in zip(offsets[:-1], offsets[1:])], pa.binary()),
                "share": pa.array([xxhash.xxh32_intdigest(key[0].as_py()) % ROUNDS] * size, pa.int32()),
            },
            schema=schema,
        )

    return read.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(run, TEXTS)


# the model


def class_bounds(mass: np.ndarray, n_words: int, classes: int = CLASSES) -> np.ndarray:
    """Where the classes begin, and the end. Symbols come by frequency; classes of words share the roots of it evenly.

    So the classes of frequent words are small, and a token meets few symbols on average. The bins are the last class.
    """
    root = np.cumsum(np.sqrt(mass[:n_words]))
    if not n_words:
        return np.array([0, len(mass)])
    cuts = np.searchsorted(root, root[-1] * np.arange(1, classes - 1) / (classes - 1), "right")
    return np.unique(np.r_[0, cuts, n_words, len(mass)])


class LogBilinear:
    """Class and symbol scores of a context h, the sum of a[k] * r[symbol at place k]: q[c] . h + b[c], w[s] . h + u[s]."""

    def __init__(self, bounds: np.ndarray, mass: np.ndarray, vector: int = VECTOR, seed: int = 2) -> None:
        r = np.random.default_rng(seed)
        size = len(mass)
        self.bounds = bounds
        self.class_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        smooth = np.asarray(mass, float) + 0.5
        by_class = np.add.reduceat(smooth, bounds[:-1])
        self.share, self.class_share = smooth / by_class[self.class_of], by_class / by_class.sum()
        f = np.float32
        self.p = {
            # the last row stands for the places before a text
            "r": r.normal(0, 0.3, (size + 1, vector)).astype(f),
            "a": np.array([[1.0], [0.8], [0.6], [0.5]][:PLACES], f) * np.ones((PLACES, vector), f),
            "q": r.normal(0, 0.05, (len(bounds) - 1, vector)).astype(f),
            "b": np.log(self.class_share).astype(f),
            "w": r.normal(0, 0.05, (size, vector)).astype(f),
            "u": np.log(self.share).astype(f),
        }

    def contexts(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(tokens, PLACES): the symbols before each token, nearest first; of places before the text the last row's."""
        before = len(self.share)
        out = np.full((len(symbols), PLACES), before, np.int64)
        since = np.arange(len(symbols)) - np.repeat(offsets[:-1], np.diff(offsets))
        for k in range(PLACES):
            ok = np.flatnonzero(since > k)
            out[ok, k] = symbols[ok - k - 1]
        return out

    def hidden(self, context: np.ndarray) -> np.ndarray:
        r, a = self.p["r"], self.p["a"]
        h = r.take(context[:, 0], axis=0) * a[0]
        for k in range(1, PLACES):
            h += r.take(context[:, k], axis=0) * a[k]
        return h

    def log10(self, symbols: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each symbol after its context."""
        order = np.argsort(symbols.astype(_smallest(len(self.share))), kind="stable")
        # by symbol and so by class
        symbols = symbols[order]
        cls = self.class_of[symbols]
        q, w = self.joined("q", "b").T, self.joined("w", "u")
        h = np.ones((len(symbols), len(q)), np.float32)
        out = np.empty(len(h), np.float32)
        # so many rows at once that their scores stay in the processor's cache
        for k in range(0, len(h), CACHED):
            some = h[k : k + CACHED]
            some[:, :-1] = self.hidden(context.take(order[k : k + CACHED], axis=0))
            s = some @ q
            out[k : k + CACHED] = s[np.arange(len(s)), cls[k : k + CACHED]] - _log_sum(s)
        cuts = np.searchsorted(cls, np.arange(len(self.bounds)))
        for c in np.flatnonzero(np.diff(cuts)):
            lo, hi = self.bounds[c], self.bounds[c + 1]
            if hi - lo == 1:
                continue
            step = max(256, CACHED * len(self.bounds) // (hi - lo))
            for k in range(cuts[c], cuts[c + 1], step):
                end = min(k + step, cuts[c + 1])
                s = h[k:end] @ w[lo:hi].T
                out[k:end] += s[np.arange(len(s)), symbols[k:end] - lo] - _log_sum(s)
        got = np.empty_like(out)
        got[order] = out / np.float32(np.log(10))
        return got

    def joined(self, vectors: str, bias: str) -> np.ndarray:
        """Rows with their bias at the end, which meets a 1 at the end of h."""
        return np.c_[self.p[vectors], self.p[bias]]

    def fit(self, target: np.ndarray, context: np.ndarray, seed: int, sums: dict[str, np.ndarray] | None = None, noise: tuple[int, int] = NOISE, rate: float = RATE) -> dict[str, np.ndarray]:
        """One pass of noise-contrastive estimation over (target, context); Adagrad on what each batch touches.

        sums: squares of gradients so far, from START on, which go on in a task's next pass.

        The noise of the class step is drawn from the classes' shares, that of the symbol step from the shares within
        the target's class. Returned: for each parameter how often a row of it was touched.
        """
        p, f = self.p, np.float32
        g = np.random.default_rng(seed)
        sums = {} if sums is None else sums
        rows = {"r": p["r"], "a": p["a"], "q": self.joined("q", "b"), "w": self.joined("w", "u")}
        for k, x in rows.items():
            sums.setdefault(k, np.full(x.shape, START, f))
        batch = int(np.clip(len(target) // 64, 256, BATCH))
        touched = {k: np.zeros(len(x), f) for k, x in rows.items()}
        class_cum = np.cumsum(self.class_share)
        log_class, log_share = np.log(noise[0] * self.class_share).astype(f), np.log(noise[1] * self.share).astype(f)
        sizes = np.diff(self.bounds)
        kind = _smallest(len(self.share))

        def update(name: str, at: np.ndarray, times: np.ndarray, d: np.ndarray) -> None:
            # whole rows are written at once, and few enough to stay in the processor's cache
            to, to_sums = _whole_rows(rows[name]), _whole_rows(sums[name])
            for k in range(0, len(at), CACHED >> 1):
                i, x = at[k : k + (CACHED >> 1)], d[k : k + (CACHED >> 1)]
                s = sums[name].take(i, axis=0)
                s += x * x
                to_sums[i] = _whole_rows(s)
                np.sqrt(s, out=s)
                np.divide(x, s, out=s)
                s *= rate
                to[i] = _whole_rows(rows[name].take(i, axis=0) - s)
            touched[name][at] += times

        order = g.permutation(len(target))
        for k in range(0, len(order), batch):
            at = order[k : k + batch]
            # by symbol and so by class
            at = at[np.argsort(target[at].astype(kind), kind="stable")]
            t, ctx = target[at], context.take(at, axis=0).T.ravel()
            cls = self.class_of[t]
            n = len(t)
            near = rows["r"].take(ctx, axis=0).reshape(PLACES, n, -1)
            h = np.ones((n, near.shape[2] + 1), f)
            np.einsum("knd,kd->nd", near, rows["a"], out=h[:, :-1])
            # the class: all positions are held against the same draws
            drawn = np.minimum(np.searchsorted(class_cum, g.random(noise[0]) * class_cum[-1], "right"), len(class_cum) - 1)
            q, others = rows["q"].take(cls, axis=0), rows["q"][drawn]
            others[:, -1] -= log_class[drawn]
            e = _sigmoid(np.einsum("nd,nd->n", q, h) - log_class[cls]) - 1
            d = _sigmoid(h @ others.T)
            dh = d @ others[:, :-1]
            dh += e[:, None] * q[:, :-1]
            grads = (np.arange(len(class_cum))[:, None] == drawn).astype(f) @ (d.T @ h)
            cuts = np.searchsorted(cls, np.arange(len(grads) + 1))
            for c in np.flatnonzero(np.diff(cuts)).tolist():
                grads[c] += e[cuts[c] : cuts[c + 1]] @ h[cuts[c] : cuts[c + 1]]
            update("q", np.arange(len(grads)), np.diff(cuts) + np.bincount(drawn, minlength=len(grads)), grads)
            # the symbol within it
            some = np.flatnonzero(sizes[cls] > 1)
            if len(some):
                hs = h if len(some) == n else h.take(some, axis=0)
                x = np.empty((len(some), 1 + noise[1]), np.int64)
                x[:, 0], x[:, 1:] = t[some], self.draws(cls[some], g.random((len(some), noise[1])))
                wx = rows["w"].take(x, axis=0)
                e = _sigmoid(np.einsum("nkd,nd->nk", wx, hs) - log_share.take(x))
                e[:, 0] -= 1
                back = np.einsum("nk,nkd->nd", e, wx[:, :, :-1])
                if len(some) == n:
                    dh += back
                else:
                    dh[some] += back
                symbols = _Groups(x.ravel(), len(self.share))
                update("w", symbols.at, symbols.times, symbols.total(hs, symbols.order // x.shape[1], e.ravel().take(symbols.order)))
            before = _Groups(ctx, len(p["r"]))
            da = np.stack([np.einsum("nd,nd->d", dh, x) for x in near])
            update("r", before.at, before.times, before.total((dh * rows["a"][:, None]).reshape(len(ctx), -1), before.order))
            update("a", np.arange(PLACES), np.ones(PLACES, f), da / np.sqrt(f(n)))
        for vectors, bias, name in (("q", "b", "q"), ("w", "u", "w")):
            p[vectors][:], p[bias][:] = rows[name][:, :-1], rows[name][:, -1]
            touched[bias] = touched[name]
        return touched

    @cached_property
    def alias(self) -> tuple[np.ndarray, np.ndarray]:
        """Walker's tables of the symbols of each class: how much of a symbol's cell is its own, and whose the rest is."""
        own, other = np.ones(len(self.share)), np.arange(len(self.share))
        for lo, hi in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()):
            left = (self.share[lo:hi] / self.share[lo:hi].sum() * (hi - lo)).tolist()
            low, high = [k for k, x in enumerate(left) if x < 1], [k for k, x in enumerate(left) if x >= 1]
            while low and high:
                k, m = low.pop(), high[-1]
                own[lo + k], other[lo + k] = left[k], lo + m
                left[m] -= 1 - left[k]
                if left[m] < 1:
                    low.append(high.pop())
        return own, other

    def draws(self, cls: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Symbols of the classes by their shares; u: a row of numbers from 0 to 1 for each."""
        own, other = self.alias
        lo, n = self.bounds[cls][:, None], np.diff(self.bounds)[cls][:, None]
        u = u * n
        cell = np.minimum(u.astype(np.int64), n - 1)
        u -= cell
        cell += lo
        return np.where(u < own.take(cell), cell, other.take(cell))


def _whole_rows(x: np.ndarray) -> np.ndarray:
    return x.view(f"V{x.shape[1] * x.itemsize}").ravel()


def _smallest(size: int) -> type:
    """Of numbers under size; those of two bytes are sorted by radix."""
    return np.uint16 if size <= 1 << 16 else np.int32


class _Groups:
    """Numbers under size, brought into order: the distinct ones (at), how often each comes (times), and sums by them.

    The distinct ones come by times, the most frequent first.
    """

    #: Members of a group that are added member by member, all groups at once
    FEW = 16

    def __init__(self, rows: np.ndarray, size: int) -> None:
        rows = rows.astype(_smallest(size))
        self.order = np.argsort(rows, kind="stable")
        rows = rows[self.order]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        times = np.diff(starts, append=len(rows))
        by = np.argsort((len(rows) - times).astype(_smallest(len(rows))), kind="stable")
        self.starts, self.times = starts[by], times[by]
        self.at = rows[self.starts].astype(np.int64)
        # how many groups have more members than 0, 1, 2 and so on
        self.more = len(times) - np.searchsorted(self.times[::-1], np.arange(self.FEW + 1), "right")

    def total(self, x: np.ndarray, rows: np.ndarray | None = None, factor: np.ndarray | None = None) -> np.ndarray:
        """Sums by group of x, whose rows are in the order; or of factor[i] * x[rows[i]], where i is the order."""

        def members(at: np.ndarray) -> np.ndarray:
            if rows is None:
                return x.take(at, axis=0)
            got = x.take(rows.take(at), axis=0)
            if factor is not None:
                got *= factor.take(at)[:, None]
            return got

        out = members(self.starts)
        many = self.more[self.FEW]
        for k in range(1, self.FEW):
            if self.more[k] > many:
                out[many : self.more[k]] += members(self.starts[many : self.more[k]] + k)
        ones = np.ones(self.times[0], x.dtype)
        for k, (at, n) in enumerate(zip(self.starts[:many].tolist(), self.times[:many].tolist())):
            of = x[at : at + n] if rows is None else x.take(rows[at : at + n], axis=0)
            out[k] = (ones[:n] if factor is None else factor[at : at + n]) @ of
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """x is overwritten."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


#: exp of scores up to this size, and sums of it, are neither infinite nor zero
PLAIN = 60


def _log_sum(s: np.ndarray) -> np.ndarray:
    """log of the sum of exp of each row; s is overwritten."""
    m = None
    if not -PLAIN <= s.min() <= s.max() <= PLAIN:
        m = s.max(axis=1)
        s -= m[:, None]
    np.exp(s, out=s)
    out = np.log(s @ np.ones(s.shape[1], s.dtype))
    return out if m is None else out + m


def _tokens(blobs: list[bytes], width: str) -> tuple[np.ndarray, np.ndarray]:
    size = np.dtype(width).itemsize
    offsets = np.r_[0, np.cumsum([len(x) // size for x in blobs])].astype(np.int64)
    return np.frombuffer(b"".join(blobs), width).astype(np.int64), offsets


#: Rows of a parameter that are sent together, and the block that says how many tokens a task trained on
ROWS, TRAINED = 8192, "trained"


def _train(texts: DataFrame, model: LogBilinear, v: Vocabulary, share: int, width: str) -> int:
    """One round: every task trains the model on all tokens of its training documents of this share.

    What the tasks changed is averaged. Returned: how many tokens the model was trained on.

    A row of a parameter is averaged over the tasks that touched it, by how often. Only changes come to the driver,
    added up before by blocks of rows: as much as the model itself, whatever the number of tasks.
    """
    weights = {k: x.copy() for k, x in model.p.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = LogBilinear(model.bounds, v.mass)
        net.p = {k: x.copy() for k, x in weights.items()}
        touched = {k: np.zeros(len(x), np.float32) for k, x in net.p.items()}
        targets = 0
        sums: dict[str, np.ndarray] = {}
        for number, table in enumerate(chunked(batches, "symbols", CHUNK >> 2)):
            sym, offsets = _tokens(table.column("symbols").to_pylist(), width)
            sym = v.left_out(sym, number)
            for k, n in net.fit(sym, net.contexts(sym, offsets), share + ROUNDS * number, sums).items():
                touched[k] += n
            targets += len(sym)
        for name, n in touched.items():
            for k in range(0, len(n), ROWS):
                at = k + np.flatnonzero(n[k : k + ROWS])
                if len(at):
                    change = (net.p[name][at] - weights[name][at]).reshape(len(at), -1) * n[at, None]
                    blob = compress(struct.pack("<q", len(at)) + at.astype("<i4").tobytes() + n[at].astype("<f4").tobytes() + change.astype("<f4").tobytes(), 1)
                    yield pa.record_batch([pa.array([f"{name}{k}"]), pa.array([blob], pa.binary())], names=["block", "blob"])
        yield pa.record_batch([pa.array([TRAINED]), pa.array([struct.pack("<q", targets)], pa.binary())], names=["block", "blob"])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() == TRAINED:
            targets = sum(struct.unpack("<q", b)[0] for b in table.column("blob").to_pylist())
            return pa.table([pa.array([TRAINED]), pa.array([struct.pack("<q", targets)], pa.binary())], names=["block", "blob"])
        rows, n, change = (np.concatenate(x) for x in zip(*(_change(b) for b in table.column("blob").to_pylist())))
        at, which = np.unique(rows, return_inverse=True)
        sums, times = np.zeros((len(at), change.shape[1]), np.float64), np.zeros(len(at))
        np.add.at(sums, which, change)
        np.add.at(times, which, n)
        mean = (sums / times[:, None]).astype("<f4")
        blob = struct.pack("<q", len(at)) + at.astype("<i4").tobytes() + times.astype("<f4").tobytes() + mean.tobytes()
        return pa.table([pa.array([key[0].as_py()]), pa.array([compress(blob, 1)], pa.binary())], names=["block", "blob"])

    some = texts.where(~F.col("held_out") & (F.col("share") == share)).select("symbols")
    some = some.coalesce(max(1, v.tokens // ROUNDS // TARGETS))
    trained = 0
    for r in some.mapInArrow(run, "block string, blob binary").groupBy("block").applyInArrow(add, "block string, blob binary").toLocalIterator():
        if r["block"] == TRAINED:
            trained = struct.unpack("<q", r["blob"])[0]
            continue
        name = r["block"][0]
        at, _, mean = _change(bytes(r["blob"]))
        model.p[name][at] += mean.reshape(len(at), *model.p[name].shape[1:])
    return trained


def _change(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = expand(blob)
    n = struct.unpack_from("<q", data)[0]
    return np.frombuffer(data, "<i4", n, 8), np.frombuffer(data, "<f4", n, 8 + 4 * n), np.frombuffer(data, "<f4", -1, 8 + 8 * n).reshape(n, -1)


def score(docs: DataFrame, held_out: Column, seed: int = 2, size: int = VOCABULARY, chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Counts and the model come from the rows where held_out (a column over docs; null counts as false) is not true.
    Null and empty texts are one end token. Without training rows every token is unseen and score is the untrained
    model's. Repeated rows are counted and scored one by one; an empty table gives no rows. score is the log10
    probability of the whole text with its end, every unseen word being one event; spelled_score is that with each
    unseen word one of V + 1.
    """
    spark = docs.sparkSession
    parts = bucket_count(spark, text_bytes(docs), 32 << 20)
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    read = stage(_read(rows, parts, chunk), "lbl-read")
    stats = stage(_total(read.where("part is not null").select("part", "chunk", "blob"), size), "lbl-counts")
    # as many groups as each has members, so that neither a task nor the driver takes more than the root of all
    v = vocabulary(stats, int(parts**0.5) + 1, size)
    width = "<u2" if v.size < 1 << 16 else "<u4"
    counts = stats.where("kind = 'counts'").select("chunk", "blob")
    texts = stage(_classify(read.where("part is null"), counts, v), "lbl-symbols")
    model = LogBilinear(class_bounds(v.mass, len(v.known)), v.mass, seed=seed)
    trained = sum(_train(texts, model, v, k, width) for k in range(ROUNDS))
    if trained != v.tokens:
        raise RuntimeError(f"trained on {trained} of {v.tokens} tokens")
    weights, bounds = model.p, model.bounds

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = LogBilinear(bounds, v.mass)
        net.p = weights
        for table in chunked(batches, "symbols", CHUNK >> 1):
            batch = table.combine_chunks().to_batches()[0]
            sym, offsets = _tokens(batch.column(6).to_pylist(), width)
            got = np.empty(len(sym))
            for k in range(0, len(sym), TOGETHER):
                # a piece is read with the places before it
                lo, hi = max(0, k - PLACES), min(k + TOGETHER, len(sym))
                cut = np.unique(np.clip(offsets, lo, hi))
                got[k:hi] = net.log10(sym[k:hi], net.contexts(sym[lo:hi], cut - lo)[k - lo :])
            within = batch.column(5).to_numpy()
            total = np.add.reduceat(got, offsets[:-1]) + within
            yield pa.record_batch([*(batch.column(k) for k in range(5)), pa.array(total)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = texts.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    spelled = F.col("score") - (F.col("n_tokens") - F.col("n_known")) * F.lit(float(np.log10(v.distinct + 1)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.tokens).cast("bigint").alias("train_tokens"), "base_score", "score", spelled.alias("spelled_score"))
