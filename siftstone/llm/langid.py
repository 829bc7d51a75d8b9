"""Language ID by compression: a text belongs to the language whose dictionary makes it smallest.

For each language a zstandard raw-content dictionary is cut from labelled texts. A text is compressed with each of
them; the smallest result names the language, and the margin to the next says how sure that is. The dictionaries are
the whole model: a few hundred kilobytes that go to the workers with the function.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import each, lean, local_table

#: Characters that aren't letters, joined by a space before compressing
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Numbers that aren't digits, as superscripts and fractions, which \\w takes for parts of words (those of one UTF-16
#: unit, which the pattern finds fast)
_NUMBERS = re.compile("[" + "".join(c for c in map(chr, range(0x10000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]+")
#: Learned texts and dictionary bytes for each language, and bytes that one text may give
TEXTS, DICT_BYTES, TEXT_BYTES = 400, 112 << 10, 2 << 10
LEVEL = 9
#: A prediction is rejected when the best size isn't this share below the next
MARGIN = 0.004
#: Cleaned bytes that are compressed at once. What a dictionary saves is bounded by its size, so a longer text is cut
#: into blocks that each start from the dictionary anew; the margin of their sums doesn't shrink with the length.
BLOCK_BYTES = 160 << 10


def cleaned(text: str) -> bytes:
    if not text.isascii():
        text = _NUMBERS.sub(" ", text)
    return _NOT_LETTERS.sub(" ", text).strip().lower().encode()


def learn(docs: DataFrame, usable: Column | None = None, texts: int = TEXTS, dict_bytes: int = DICT_BYTES, max_langs: int = 300) -> dict[str, bytes]:
    """A dictionary for each non-null lang of docs (doc_id, text, lang), from the rows that usable allows.

    The sample is bounded, whatever the table holds: of each language about texts rows, those with the smallest
    hash of doc_id, of each text its first TEXT_BYTES cleaned bytes and more in turn until dict_bytes are filled. Rows
    are counted first, so that hardly more than the sample is ranked. Of over max_langs languages the most frequent are
    learned, of those as frequent the first by name. Rows without a doc_id or text aren't learned from; of rows that
    repeat a doc_id and language the text that sorts first is.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    if not counts:
        return {}
    # the share of a language's rows that holds texts of them, with room for chance
    room = texts + 8 * int(texts**0.5) + 8
    cut = [float(min(1.0, room / r["count"]) * (1 << 32)) for r in counts]
    cuts = local_table(docs.sparkSession, {"lang": [r["lang"] for r in counts], "cut": cut}, {"lang": "string", "cut": "double"})
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    ids = rows.select("doc_id", "lang", h.alias("h")).join(F.broadcast(cuts), "lang").where(F.col("h") < F.col("cut")).select("doc_id", "lang", "h").distinct()
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = ids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= texts).select("doc_id", "lang").collect()
    bound = local_table(docs.sparkSession, {c: [r[c] for r in chosen] for c in ("doc_id", "lang")}, {"doc_id": "bigint", "lang": "string"})
    got = rows.select("doc_id", "lang", F.substring("text", 1, dict_bytes).alias("text")).join(F.broadcast(bound), ["doc_id", "lang"], "left_semi")
    got = got.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    by_lang: dict[str, list[bytes]] = {}
    for r in got.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        by_lang.setdefault(r["lang"], []).append(cleaned(r["text"]))
    return {lang: _dictionary(parts, dict_bytes) for lang, parts in sorted(by_lang.items())}


def _dictionary(parts: list[bytes], limit: int) -> bytes:
    out, size, k = [], 0, 0
    while size < limit and any(len(p) > k for p in parts):
        for p in parts:
            if size < limit and (cut := p[k : k + TEXT_BYTES]):
                out.append(cut)
                size += len(cut) + 1
        k += TEXT_BYTES
    # zstandard finds what stands near the end at the smallest offsets
    return b" ".join(out)[:limit]


@functools.lru_cache(maxsize=4)
def _compressors(model: tuple[tuple[str, bytes], ...], level: int) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, data in model:
        shared = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(level=level)
        out.append((lang, zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def blocks(data: bytes) -> list[bytes]:
    """data in as few pieces of at most BLOCK_BYTES as it takes, of equal length but for a byte."""
    n = -(-len(data) // BLOCK_BYTES)
    return [data[len(data) * k // n : len(data) * (k + 1) // n] for k in range(n)]


def predict(text: str | None, model: tuple[tuple[str, bytes], ...], margin: float = MARGIN, level: int = LEVEL) -> tuple[str, float, float, bool]:
    """(language, score, margin, rejected). Without a letter: und, 0, 0, rejected.

    Sizes are sums over the blocks of the whole text. score is the winner's share of exp(-bits saved) over the
    languages, kept within 0 and 1 by construction.
    """
    data = cleaned(text or "")
    if not data or not model or not any(map(str.isalpha, text)):
        return "und", 0.0, 0.0, True
    parts = blocks(data)
    sizes = sorted((sum(len(c.compress(x)) for x in parts), lang) for lang, c in _compressors(model, level))
    best = sizes[0][0]
    gap = (sizes[1][0] - best) / sizes[1][0] if len(sizes) > 1 else 1.0
    score = 1 / sum(2.0 ** max(best - s, -60) for s, _ in sizes)
    return sizes[0][1], score, gap, gap < margin


def identify(docs: DataFrame, model: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """docs (with text) and lang_pred, score, margin, rejected, of each whole text.

    Null texts and texts without a letter are und and rejected. Of languages with equal sizes the first by name is
    named, with margin 0, so it is rejected when margin is above 0. Columns with those names are replaced. An empty
    model names everything und. Rows and their other columns stay as they are.
    """
    frozen = tuple(sorted(model.items()))
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "margin", "rejected")]
    at = keep.index("text")

    def run(batches):
        for batch in batches:
            got = [predict(t, frozen, margin) for t in each(batch.column(at))]
            lang, score, gap, out = zip(*got) if got else ((), (), (), ())
            new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.float64()), pa.array(out, pa.bool_())]
            yield pa.record_batch([*batch.columns, *new], names=[*keep, "lang_pred", "score", "margin", "rejected"])

    schema = docs.select(keep).schema.add("lang_pred", "string").add("score", "double").add("margin", "double").add("rejected", "boolean")
    return docs.select(keep).mapInArrow(lean(run), schema)
