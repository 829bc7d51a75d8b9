"""Suffix-array dedup: bytes of strings that an earlier document has are removed, the first copy is kept.

A string of LENGTH bytes holds LENGTH - GRAM + 1 grams; the one with the smallest hash is its anchor, and equal strings
have the same anchor at the same place. So documents are first compared by anchors:

1. Each document's anchors, with a hash of all that any string of that anchor can reach (its context), are dealt by
   anchor. Repeats within a task are settled there; what is dealt is one document's for each context and task.
2. An anchor whose context an earlier document has is covered whole. Where an anchor has different contexts, their
   bytes are asked for.
3. Documents, packed and compressed by bucket, answer with contexts, dealt by anchor again. Each task joins its
   contexts to one text, and the longest-previous-factor array of that text, by previous and next smaller documents in
   suffix order, tells how long a match with an earlier document each place begins.
4. Spans meet their documents once, by bucket.

An anchor with many contexts is hot: its contexts are dealt as single strings instead, which can be split at will and
are settled as in 1 and 2. A task that finds an anchor's contexts in more than its share of HOT documents doesn't deal
them by the anchor at all, but says so to the anchor's task, which treats what others dealt to it alike. So an anchor
brings no more than HOT contexts, or one for each task of step 1, together.

Texts are shuffled compressed. Anchors and contexts are compared by 64 bits each, rows are known by doc_id and 64 bits
of their text; contexts that meet in step 3 are compared by their bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, chunked, compress, expand, packed_buckets, stage, text_bytes, unpack_table
from .lpf import longest_previous_factor

LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM
PAD = 96
CHUNK, SLICE = 8 << 20, 1 << 20
#: Contexts that are put into one text
TOGETHER = 20_000
HOT = 20_000
#: Stands for a null doc_id: later than all others
LAST = (1 << 63) - 1
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _A
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def bucket_of(doc: np.ndarray, n: int) -> np.ndarray:
    """pmod(xxhash64(doc), n) as Spark has it: XXH64 of eight bytes, seed 42."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = np.full(len(doc), p5 + np.uint64(50), np.uint64)
    h ^= rot(doc.astype(np.int64).view(np.uint64) * p2, 31) * p1
    h = rot(h, 27) * p1 + p4
    h ^= h >> np.uint64(33)
    h *= p2
    h ^= h >> np.uint64(29)
    h *= p3
    h ^= h >> np.uint64(32)
    return np.mod(h.view(np.int64), n)


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer with PAD zeros around each text, starts, lengths)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = PAD + np.r_[0, np.cumsum(lengths + PAD)[:-1]].astype(np.int64) if len(texts) else np.empty(0, np.int64)
    pad = bytes(PAD)
    buf = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
    return buf, starts, lengths


def _words(buf: np.ndarray) -> np.ndarray:
    return np.ndarray((len(buf) - 7,), "<u8", buf.data, strides=(1,))


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width], for each i that has all of it."""
    done, size = x, 1
    while size * 2 <= width:
        done = op(done[: len(done) - size], done[size:])
        size *= 2
    rest = width - size
    return op(done[: len(done) - rest], done[rest:]) if rest else done


def anchors(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the grams that are smallest of some string of LENGTH bytes within a text."""
    n = len(buf) - GRAM + 1
    w = np.array(_words(buf))
    h = w[:n] * _A
    h ^= h >> np.uint64(31)
    h += w[8 : 8 + n] * _B
    h ^= h >> np.uint64(29)
    h *= _C
    h += w[12 : 12 + n] * _A
    del w
    h = _mix(h) | np.uint64(1)
    least = _sliding(h, REACH + 1, np.minimum)
    valid = np.zeros(len(least) + 1, np.int32)
    long = lengths >= LENGTH
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, starts[long] + lengths[long] - LENGTH + 1, -1)
    least = np.where(np.cumsum(valid[:-1]) > 0, least, np.uint64(0))
    # the windows that hold the gram at p start at p - REACH ... p
    most = _sliding(np.r_[np.zeros(REACH, np.uint64), least, np.zeros(n - len(least), np.uint64)], REACH + 1, np.maximum)
    at = np.flatnonzero(most[:n] == h)
    return at, h[at]


def context_hashes(buf: np.ndarray, at: np.ndarray, before: int, after: int) -> np.ndarray:
    """Of the bytes from REACH before to LENGTH after each position, and of how much of that lies in the text."""
    w = _words(buf)
    out = (np.minimum(before, REACH) * 64 + np.minimum(after, LENGTH)).astype(np.uint64) * _C
    for k in range(-REACH - 2, LENGTH, 8):
        word = w[at + k]
        if k < -REACH:
            word = word >> np.uint64(8 * (-REACH - k))
        out = _mix(out ^ word) + _B
    return out


def settle(h, ctx, doc):
    """Order by (h, ctx, doc), and in it: the first place of each (h, ctx), and which places an earlier doc covers."""
    order = np.lexsort((doc, ctx, h))
    hs, cs, ds = h[order], ctx[order], doc[order]
    new = np.r_[True, (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])] if len(order) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    covered = ds > ds[new][group] if len(order) else np.empty(0, bool)
    return order, new, group, covered


def _pack(cols: list[np.ndarray]) -> bytes:
    return compress(struct.pack("<q", len(cols[0])) + b"".join(np.ascontiguousarray(c).tobytes() for c in cols), 1)


def _unpack(blobs: Iterable[bytes], kinds: list[str]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for b in blobs:
        data = expand(b)
        n, at = struct.unpack_from("<q", data)[0], 8
        for k, kind in enumerate(kinds):
            size = n * np.dtype(kind).itemsize
            parts[k].append(np.frombuffer(data, kind, n, at))
            at += size
    return [np.concatenate(p) if p else np.empty(0, kind) for p, kind in zip(parts, kinds)]


ENTRY = ["<u8", "<u8", "<i8", "<i8", "<u4"]  # anchor, context, doc, variant, position
SPAN = ["<i8", "<i8", "<i4", "<i4"]  # doc, variant, start, end
OUT = "kind string, part int, blob binary"


def _deal(kind: str, parts: np.ndarray, cols: list[np.ndarray]) -> Iterator[tuple[str, int, bytes]]:
    order = np.argsort(parts, kind="stable")
    parts = parts[order]
    cuts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(parts) else []
    for s, e in zip(cuts, [*cuts[1:], len(parts)] if len(parts) else []):
        at = order[s:e]
        yield kind, int(parts[s]), _pack([c[at] for c in cols])


def _spans(doc, variant, start, end, n_buckets: int) -> Iterator[tuple[str, int, bytes]]:
    """Spans merged where they touch, dealt to their documents' buckets."""
    if len(doc):
        doc, variant, start, end = merged(doc, variant, np.maximum(start, 0), end)
        yield from _deal("span", bucket_of(variant, n_buckets), [doc.astype("<i8"), variant.astype("<i8"), start.astype("<i4"), end.astype("<i4")])


def merged(doc, variant, start, end):
    order = np.lexsort((start, variant, doc))
    doc, variant, start, end = doc[order], variant[order], start[order].astype(np.int64), end[order].astype(np.int64)
    new = np.r_[True, (doc[1:] != doc[:-1]) | (variant[1:] != variant[:-1])]
    # the largest end so far within a document: documents are lifted above each other first
    lift = (np.cumsum(new) - 1) * (1 << 33)
    top = np.maximum.accumulate(end + lift)
    begin = np.r_[True, start[1:] + lift[1:] > top[:-1]]
    last = np.r_[np.flatnonzero(begin)[1:] - 1, len(doc) - 1]
    return doc[begin], variant[begin], start[begin], (top - lift)[last]


def _batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    kind, part, blob = zip(*rows) if rows else ((), (), ())
    return pa.record_batch([pa.array(kind, pa.string()), pa.array(part, pa.int32()), pa.array(blob, pa.binary())], names=["kind", "part", "blob"])


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(docs, variants, texts) in the order of docs. A variant tells rows apart that share a doc_id."""
    table = table.sort_by([("doc", "ascending"), ("variant", "ascending")])
    texts = [(t or "").encode() for t in table.column("text").to_pylist()]
    return table.column("doc").to_numpy().astype(np.int64), table.column("variant").to_numpy().astype(np.int64), texts


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h * _A >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _entries(h, ctx, doc, variant, pos, before: int, size: int, parts: int, n_buckets: int, share: int | None = None) -> Iterator[tuple[str, int, bytes]]:
    """What a task deals of its own entries: spans of those that an earlier document here covers, and the others.

    share: anchors with more contexts than that are dealt as hot, to their documents, and flagged to their parts.
    """
    order, new, _, covered = settle(h, ctx, doc)
    hit, rest = order[covered], np.sort(order[~covered])
    yield from _spans(doc[hit], variant[hit], pos[hit] - before, pos[hit] + size, n_buckets)
    if share is not None and len(order):
        anchor, contexts = np.unique(h[order[new]], return_counts=True)
        hot = anchor[contexts > share]
        if len(hot):
            yield from _deal("flag", _part_of(hot, parts), [hot])
            on = np.isin(h[rest], hot)
            x, rest = rest[on], rest[~on]
            yield from _deal("hot", bucket_of(variant[x], n_buckets), [h[x], ctx[x], doc[x].astype("<i8"), variant[x].astype("<i8"), pos[x].astype("<u4")])
    yield from _deal("entry", _part_of(h[rest], parts), [h[rest], ctx[rest], doc[rest].astype("<i8"), variant[rest].astype("<i8"), pos[rest].astype("<u4")])


def _find(docs: DataFrame, parts: int, n_buckets: int, chunk: int, share: int) -> DataFrame:
    def run(batches):
        for table in chunked(batches, "text", chunk):
            doc, variant, texts = _rows(table)
            ends = np.cumsum([len(t) for t in texts]) if texts else np.empty(0)
            found = []
            # anchors are sought in a slice of the documents at a time, as that takes many times a slice's memory
            for k in range(int(ends[-1] // SLICE) + 1 if len(ends) else 0):
                # a document belongs to the slice in which it ends
                s, e = np.searchsorted(ends, [k * SLICE, (k + 1) * SLICE])
                if s < e:
                    found.append(_anchored(doc[s:e], variant[s:e], texts[s:e]))
            if found:
                h, ctx, d, v, pos = (np.concatenate(x) for x in zip(*found))
                yield _batch(list(_entries(h, ctx, d, v, pos, REACH, LENGTH, parts, n_buckets, share)))

    return docs.mapInArrow(run, OUT)


def _anchored(doc: np.ndarray, variant: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(anchor, context, doc, variant, position) of all anchors of the texts."""
    buf, starts, lengths = layout(texts)
    at, h = anchors(buf, starts, lengths)
    which = np.searchsorted(starts, at, "right") - 1
    pos = at - starts[which]
    return h, context_hashes(buf, at, pos, lengths[which] - pos), doc[which], variant[which], pos


def _kinds(table: pa.Table, through: tuple[str, ...]) -> tuple[dict[str, list[bytes]], list[tuple[str, int, bytes]]]:
    """The blobs of a group by kind, and the rows of those kinds that only pass through."""
    blobs: dict[str, list[bytes]] = {}
    passed = []
    for row in zip(*(table.column(c).to_pylist() for c in ("kind", "part", "blob"))):
        if row[0] in through:
            passed.append(row)
        else:
            blobs.setdefault(row[0], []).append(row[2])
    return blobs, passed


def _covered(blobs: list[bytes], before: int, size: int, n_buckets: int):
    """(spans of the entries that an earlier document covers, what settle() found)."""
    h, ctx, doc, variant, pos = _unpack(blobs, ENTRY)
    pos = pos.astype(np.int64)
    order, new, group, covered = settle(h, ctx, doc)
    hit = order[covered]
    return list(_spans(doc[hit], variant[hit], pos[hit] - before, pos[hit] + size, n_buckets)), (h, ctx, doc, variant, pos, order, new, group, covered)


def _resolve(found: DataFrame, parts: int, n_buckets: int, hot: int) -> DataFrame:
    """By anchor: spans of covered entries, and requests for the contexts of anchors that have several or are flagged."""

    def run(table: pa.Table) -> pa.Table:
        blobs, rows = _kinds(table, ("span", "hot"))
        flagged = _unpack(blobs.get("flag", []), ["<u8"])[0]
        more, (h, ctx, doc, variant, pos, order, new, group, covered) = _covered(blobs.get("entry", []), REACH, LENGTH, n_buckets)
        rows += more
        if len(order):
            hs, ds = h[order], doc[order]
            anchor = np.r_[True, hs[1:] != hs[:-1]]
            begins = np.flatnonzero(anchor)
            number = np.cumsum(anchor) - 1
            contexts = np.add.reduceat(new.astype(np.int64), begins)
            firsts = ds[new][group]
            differ = np.minimum.reduceat(firsts, begins) != np.maximum.reduceat(firsts, begins)
            # what a flagged anchor's contexts have to be compared with isn't here
            elsewhere = np.isin(hs[begins], flagged)
            asked = ((contexts > 1) & differ | elsewhere)[number] & ~covered
            at = order[asked]
            kept = np.add.reduceat((~covered).astype(np.int64), begins)
            flag = ((kept > hot) | elsewhere)[number][asked]
            for kind, on in (("ask", ~flag), ("hot", flag)):
                x = at[on]
                rows += list(_deal(kind, bucket_of(variant[x], n_buckets), [h[x], ctx[x], doc[x], variant[x], pos[x].astype("<u4")]))
        return pa.Table.from_batches([_batch(rows)])

    return _by_part(found, parts).applyInArrow(run, OUT)


def _by_part(rows: DataFrame, parts: int):
    """Entries and contexts by part; spans, whose part is a bucket, anywhere."""
    return rows.groupBy(F.pmod("part", F.lit(parts)))


def _answer(docs: DataFrame, asks: DataFrame, parts: int, n_buckets: int) -> DataFrame:
    """Contexts (or single strings, for hot anchors) that were asked for, from the documents of each bucket."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[str, int, bytes]] = []
        if left.num_rows and right.num_rows:
            doc, variant, texts = _rows(unpack_table(left.column("blob").to_pylist()))
            buf, starts, lengths = layout(texts)
            row_of = {(int(d), int(v)): k for k, (d, v) in enumerate(zip(doc, variant))}
            kinds, blobs = right.column("kind").to_pylist(), right.column("blob").to_pylist()
            for kind in ("ask", "hot"):
                h, _, d, v, pos = _unpack([b for x, b in zip(kinds, blobs) if x == kind], ENTRY)
                if not len(h):
                    continue
                which = np.fromiter((row_of[x] for x in zip(d.tolist(), v.tolist())), np.int64, len(d))
                pos = pos.astype(np.int64)
                low = np.maximum(pos - REACH, 0)
                high = np.minimum(pos + LENGTH, lengths[which])
                if kind == "ask":
                    view = np.lib.stride_tricks.sliding_window_view(buf, REACH + LENGTH)
                    part = _part_of(h, parts)
                    order = np.argsort(part, kind="stable")
                    cuts = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
                    for s, e in zip(cuts, [*cuts[1:], len(order)]):
                        at = order[s:e]
                        body = np.ascontiguousarray(view[starts[which[at]] + low[at]])
                        cols = [h[at], d[at], v[at], low[at].astype("<u4"), (high - low)[at].astype("<u2")]
                        rows.append(("context", int(part[order[s]]), _pack([*cols, body.reshape(-1).view(f"V{REACH + LENGTH}")])))
                else:
                    n = high - low - LENGTH + 1
                    owner = np.repeat(np.arange(len(h)), n)
                    begin = low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                    at = starts[which[owner]] + begin
                    w = _words(buf)
                    one, two = np.full(len(at), 1, np.uint64), np.full(len(at), 2, np.uint64)
                    for k in (0, 8, 16, 24, 32, 40, 42):
                        one, two = _mix(one ^ w[at + k]) + _B, _mix(two + w[at + k] * _C)
                    rows += list(_entries(one, two, d[owner], v[owner], begin, 0, LENGTH, parts, n_buckets))
        return pa.Table.from_batches([_batch(rows)])

    return docs.groupBy("bucket").cogroup(asks.withColumnRenamed("part", "bucket").groupBy("bucket")).applyInArrow(run, OUT)


def _compare(answered: DataFrame, parts: int, n_buckets: int) -> DataFrame:
    """Spans that an earlier document has: of contexts by longest-previous-factor arrays, of single strings by hash."""
    width = REACH + LENGTH

    def shared(doc, size, body):
        """(context, place, length) of the matches of LENGTH bytes or more with contexts of smaller docs."""
        text = body.reshape(-1, width)
        owner = np.unique(doc, return_inverse=True)[1].astype(np.int64)
        # a string counts, on either side, where it lies within its context
        room = size[:, None].astype(np.int64) - np.arange(width)[None, :]
        of = np.where(room >= LENGTH, owner[:, None], len(owner)).reshape(-1)
        factor, source = longest_previous_factor(text.reshape(-1), of, width, LENGTH)
        room = room.reshape(-1)
        at = np.flatnonzero((factor >= LENGTH) & (room >= LENGTH))
        # and so far as it does
        return at // width, at % width, np.minimum(factor[at], np.minimum(room[at], room[source[at]]))

    def run(table: pa.Table) -> pa.Table:
        blobs, rows = _kinds(table, ("span",))
        rows += _covered(blobs.get("entry", []), 0, LENGTH, n_buckets)[0]
        h, doc, variant, low, size, body = _unpack(blobs.get("context", []), ["<u8", "<i8", "<i8", "<u4", "<u2", f"V{width}"])
        order = np.argsort(h, kind="stable")
        body = body.view(np.uint8).reshape(-1, width) if len(body) else np.empty((0, width), np.uint8)
        start = 0
        while start < len(order):
            # as many anchors as fit; an anchor's contexts stay together
            end = min(start + TOGETHER, len(order))
            if end < len(order):
                cut = end
                while cut > start and h[order[cut]] == h[order[cut - 1]]:
                    cut -= 1
                end = cut if cut > start else int(np.searchsorted(h[order], h[order[start]], "right"))
            at = order[start:end]
            row, place, length = shared(doc[at], size[at], body[at])
            begin = low[at][row].astype(np.int64) + place
            rows += list(_spans(doc[at][row], variant[at][row], begin, begin + length, n_buckets))
            start = end
        return pa.Table.from_batches([_batch(rows)])

    return _by_part(answered, parts).applyInArrow(run, OUT)


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _apply(docs: DataFrame, spans: DataFrame, keep_text: bool) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, variant, texts = _rows(unpack_table(left.column("blob").to_pylist())) if left.num_rows else ([], [], [])
        cut: dict[tuple[int, int], list[tuple[int, int]]] = {}
        if right.num_rows:
            d, v, s, e = _unpack(right.column("blob").to_pylist(), SPAN)
            for x in zip(*(c.tolist() for c in merged(d, v, s, e))):
                cut.setdefault((x[0], x[1]), []).append((x[2], x[3]))
        rows = []
        for d, v, t in zip(doc, variant, texts):
            kept, at, removed, n = [], 0, 0, 0
            for s, e in cut.get((int(d), int(v)), ()):
                e = min(e, len(t))
                kept.append(t[at:s])
                removed, at, n = removed + e - s, e, n + 1
            rest = b"".join(kept) + t[at:]
            row = {"doc_id": None if d == LAST else int(d), "n_bytes": len(t), "n_removed": removed, "n_spans": n, "kept_sha256": hashlib.sha256(rest).hexdigest()}
            rows.append({**row, "kept": rest} if keep_text else row)
        return pa.Table.from_pylist(rows, schema=schema)

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.binary())] * keep_text)
    return docs.groupBy("bucket").cogroup(spans.withColumnRenamed("part", "bucket").groupBy("bucket")).applyInArrow(run, RESULT + ", kept binary" * keep_text)


def dedup(docs: DataFrame, keep_text: bool = False, chunk: int = CHUNK, hot: int = HOT) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept bytes).

    Removed is each byte covered by a string of LENGTH bytes that also starts in a document with a smaller doc_id,
    judged on the whole input. A null text is empty. A null doc_id is later than all others, and such rows are one
    document, spread over tasks like others. Rows that share a doc_id never remove from each other. Kept bytes may end within a character. An empty
    table gives no rows; only doc_id and text are read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc"))
    rows = rows.withColumn("variant", F.xxhash64("text", "doc"))
    total = text_bytes(docs)
    n_buckets, parts = bucket_count(spark, total, 8 << 20), bucket_count(spark, total, 24 << 20)
    packed = packed_buckets(rows, "variant", ["text", "doc", "variant"], n_buckets, chunk)

    share = max(1, hot // (total // chunk + 1))
    first = stage(_resolve(_find(rows, parts, n_buckets, chunk, share), parts, n_buckets, hot), "resolved")
    answered = _answer(packed, first.where("kind in ('ask', 'hot')"), parts, n_buckets)
    spans = first.where("kind = 'span'").union(_compare(answered, parts, n_buckets))
    return _apply(packed, spans, keep_text)
