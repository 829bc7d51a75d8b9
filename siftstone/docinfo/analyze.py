"""What a document is, read from its text alone: kind, date, owner, title, some sentences, and a file name."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType

from . import dates, highlights, months, titles
from .columns import DANGLING, LABELS, MAX_BYTES, MAX_NAME
from .kind_rules import RULES
from .words import content_lines, fold_lower, norm

#: Evidence from which a date goes into the name
STRONG = 3
#: Characters in which a kind is looked for
HEAD = 600
_RULES = re.compile("|".join(f"({p.replace('(', '(?:').replace('(?:?:', '(?:')})" for _, _, p in RULES))
RESULT = "kind string, lang string, date string, date_score int, entity string, title string, highlights string, suggested_name string"
PARTS = tuple(part.split(" ")[0] for part in RESULT.split(", "))


def names_a_kind(normalised: str) -> bool:
    return _RULES.search(normalised) is not None


def opens_with_kind(normalised: str) -> bool:
    return _RULES.match(normalised) is not None


class Analyst:
    def __init__(self, names: Mapping[str, int]) -> None:
        self.reader = dates.Reader(names)

    def in_passing(self, lines: Sequence[str], k: int) -> bool:
        """Whether line k names a kind only in running prose below a heading."""
        if not titles.wrapped_prose(lines[k]) or opens_with_kind(norm(lines[k])):
            return False
        at = titles.Opening(lines, self.reader.is_date_line).heading()
        return at is not None and at < k

    def kind(self, text: str) -> tuple[str, str] | None:
        """(kind, language) named first in the head, unless in passing; an article type above a title is an article."""
        lines = content_lines(text[:HEAD])
        parts = [norm(x) for x in lines]
        where = [k for k, p in enumerate(parts) if p for _ in range(len(p) + 1)]
        for m in _RULES.finditer(" ".join(p for p in parts if p)):
            k = where[m.start()]
            if self.in_passing(lines, k):
                continue
            lang, kind, _ = RULES[m.lastindex - 1]
            return ("artigo" if titles.ARTICLE_TYPE.match(lines[k]) else kind), lang
        return None

    def analyze(self, text: str | None, ext: str | None, declared: str | None = None, prominent: Sequence[str] = (), only: Sequence[str] = ()) -> dict:
        """RESULT's values, or of those in only: sentences and all else are read apart, and only if they are asked for."""
        text = text or ""
        only = only or PARTS
        out = {"highlights": highlights.extract(text)} if "highlights" in only else {}
        if set(only) - {"highlights"}:
            out |= self._said(text, ext, declared, prominent)
        return {c: out[c] for c in only}

    def _said(self, text: str, ext: str | None, declared: str | None, prominent: Sequence[str]) -> dict:
        found = self.kind(text)
        own = self.reader.own(text)
        title = titles.declared_title(declared, text) if declared else None
        title = title or titles.title(text, prominent, names_a_kind, self.in_passing, self.reader.is_date_line)
        title = title.replace("­", "") if title else None
        label = LABELS.get(found[1], {}).get(found[0]) if found else None
        if label and title and fold_lower(label) in fold_lower(title):
            label = None
        return {
            "kind": found and found[0],
            "lang": found and found[1],
            "date": own and own[0],
            "date_score": own and own[1],
            "entity": titles.main_entity(text, found and found[0]),
            "title": title,
            "suggested_name": file_name(own[0] if own and own[1] >= STRONG else None, label, title, ext or ""),
        }


def readable(title: str) -> str:
    """A title as part of a file name: forbidden characters replaced, runs of dots and spaces closed, shouting tamed."""
    out = re.sub(r":(?=\s)", " -", title)
    out = out.translate(str.maketrans("/\\:|", "----", '*?"<>­'))
    out = "".join(" " if ord(c) < 32 or 127 <= ord(c) < 160 else c for c in out)
    out = re.sub(r"(?<!\S)\.{3,}(?!\S)", " ", out)
    return re.sub(r"^[. -]+", "", " ".join(out.split()))


def sentence_case(title: str) -> str:
    """A title all in capitals with one at its beginning; what holds digits or is short stays, as it may be a name."""
    letters = [c for c in title if c.isalpha() and c.lower() != c.upper()]
    if not letters or any(map(str.islower, letters)) or len(title.split()) < 2:
        return title
    low = " ".join(w if any(map(str.isdigit, w)) else w.lower() for w in title.split(" "))
    return low[:1].upper() + low[1:]


def cut(title: str, room: int) -> str:
    """As many whole words as fit; without punctuation and joining words at the end."""
    if len(title) > room:
        title = title[: max(room, 0) + 1].rsplit(" ", 1)[0] if " " in title[: max(room, 0) + 1] else title[: max(room, 0)]
    while True:
        new = title.rstrip(" ,;:.-–(")
        head, _, word = new.rpartition(" ")
        if head and fold_lower(word) in DANGLING:
            new = head
        if new == title:
            return new
        title = new


def file_name(date: str | None, kind: str | None, title: str | None, ext: str) -> str:
    """[date] [kind] title.ext, within 120 characters and 255 bytes; documento without kind and title."""
    end = f".{ext}" if ext else ""
    lead = "".join(f"{x} " for x in (date, kind) if x)
    whole = cut(sentence_case(readable(title or "")), MAX_NAME - len(lead))
    if not whole and not kind:
        whole = "documento"
    while len(f"{lead}{whole}{end}".encode()) > MAX_BYTES:
        whole = cut(whole, len(whole) - 8)
    return f"{(lead + whole).strip()}{end}"


def analyze(docs: DataFrame, only: Sequence[str] = ()) -> DataFrame:
    """docs with RESULT, or those of its columns that are in only: docs(text[, ext, declared_title, prominent]).

    Rows and their other columns stay as they are. Null and empty texts have nothing but a name; columns with the new
    names are replaced.
    """
    names = dict(months.by_name(docs.sparkSession))
    parts = [p for p in RESULT.split(", ") if not only or p.split(" ")[0] in only]
    asked = [p.split(" ")[0] for p in parts]
    keep = [c for c in docs.columns if c not in asked]
    at = {c: keep.index(c) for c in ("text", "ext", "declared_title", "prominent") if c in keep}
    kinds = pa.schema([(c, pa.int32() if c == "date_score" else pa.string()) for c in asked])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyst = Analyst(names)
        for batch in batches:
            get = lambda c: batch.column(at[c]).to_pylist() if c in at else [None] * batch.num_rows  # noqa: B023, E731
            rows = [analyst.analyze(t, e, d, p or (), asked) for t, e, d, p in zip(get("text"), get("ext"), get("declared_title"), get("prominent"))]
            new = pa.Table.from_pylist(rows, schema=kinds).combine_chunks()
            columns = [*batch.columns, *(c.combine_chunks() for c in new.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *kinds.names])

    schema = docs.select(keep).schema
    for part in parts:
        name, kind = part.split(" ")
        schema = schema.add(name, IntegerType() if kind == "int" else kind)
    return docs.select(keep).mapInArrow(run, schema)
