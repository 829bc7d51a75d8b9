"""Texts of files: plain text, HTML, office containers, PDF, EPUB, mail, RTF. Bytes in, (text, title) out.

One Arrow batch at a time, a file never more than once; a file that cannot be read has a null text and the row stays,
so that it isn't tried again. Old Word files, which need an outside program, are null here.
"""

from __future__ import annotations

import base64
import binascii
import io
import quopri
import re
import zipfile
from collections.abc import Iterable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import catalogue, mime
from . import pdf

#: Bytes of a text that are kept, and of an archive's member that are inflated
TEXT_CAP, INFLATE_CAP = 8 << 20, 64 << 20
#: Members of an archive that are looked at (fixed values)
MAX_ENTRIES, MAX_PARTS = 4096, 2000
MARKUP = frozenset(["html", "htm", "xhtml"])
PLAIN = frozenset(catalogue.TEXT) - MARKUP
# fixed values: parts of office documents that are read
OFFICE = {"docx": r"word/document\.xml", "odt": r"content\.xml", "ods": r"content\.xml", "odp": r"content\.xml", "xlsx": r"xl/worksheets/sheet(\d+)\.xml", "pptx": r"ppt/slides/slide(\d+)\.xml"}
#: Elements that end a line in office documents, by local name
_LINES = frozenset(["p", "h", "tr", "table-row", "si", "br", "line-break", "tab"])
_BLOCK = re.compile(r"</?(p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|section|article|header|footer|nav|blockquote|pre|title)\b[^>]*>", re.I)


def html_to_text(markup: str) -> str:
    import html

    out = re.sub(r"(?is)<(script|style)\b.*?(</\1\s*>|\Z)", "", markup)
    return html.unescape(re.sub(r"(?s)<[^>]*>", "", _BLOCK.sub("\n", out)))


def plain_text(data: bytes) -> str | None:
    """UTF-8 with replacements; null for empty data and for data with a NUL byte in its first 8 KiB."""
    if not data or b"\0" in data[:8192]:
        return None
    return data[:TEXT_CAP].decode("utf-8", "replace")


def _member(z: zipfile.ZipFile, name: str, left: int) -> bytes:
    with z.open(name) as f:
        return f.read(left)


def _xml_text(data: bytes) -> str:
    parts: list[str] = []

    def walk(e) -> None:
        name = e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
        if e.text:
            parts.append(e.text)
        for child in e:
            walk(child)
            if child.tail:
                parts.append(child.tail)
        if name in _LINES:
            parts.append("\n")

    walk(ElementTree.fromstring(data))
    return "".join(parts)


def percent_decoded(text: str) -> str:
    """%hh as bytes of UTF-8; a plus sign stays, what isn't two hexadecimal digits too."""
    raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode())
    return raw.decode("utf-8", "replace")


def _sheet_text(data: bytes, shared: list[str]) -> str:
    """Cells of a sheet, row by row: shared and inline strings, numbers and cached results as they are written."""
    rows = []
    local = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
    for row in (e for e in ElementTree.fromstring(data).iter() if local(e) == "row"):
        cells = []
        for c in (e for e in row if local(e) == "c"):
            kind = c.get("t")
            value = next((e.text or "" for e in c if local(e) == "v"), "")
            if kind == "s":
                k = int(value) if value.isdigit() else -1
                cells.append(shared[k] if 0 <= k < len(shared) else "")
            elif kind == "inlineStr":
                cells.append("".join(e.text or "" for e in c.iter() if local(e) == "t"))
            elif kind != "b":
                cells.append(value)
        rows.append("\t".join(x for x in cells if x))
    return "\n".join(x for x in rows if x)


def _shared_strings(data: bytes) -> list[str]:
    """Texts of a workbook's shared strings; phonetic readings are left out."""
    out = []
    for e in ElementTree.fromstring(data):
        parts = [t.text or "" for x in e for t in ([x] if x.tag.endswith("}t") else x if x.tag.endswith("}r") else []) if t.tag.endswith("}t")]
        out.append("".join(parts))
    return out


def office_text(data: bytes, ext: str) -> tuple[str | None, str | None]:
    """Text of the parts of a document in number order, and its declared title."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()[:MAX_ENTRIES]
        hits = [(int(m[1]) if m.groups() else 0, n) for n in names if (m := re.fullmatch(OFFICE[ext], n))]
        text, left = [], INFLATE_CAP
        strings: list[str] = []
        if ext == "xlsx" and "xl/sharedStrings.xml" in names:
            body = _member(z, "xl/sharedStrings.xml", left)
            left -= len(body)
            strings = _shared_strings(body)
        for _, name in sorted(hits)[:512]:
            body = _member(z, name, left)
            left -= len(body)
            text.append(_sheet_text(body, strings) if ext == "xlsx" else _xml_text(body))
        title = None
        for name in ("docProps/core.xml", "meta.xml"):
            if name in names:
                for e in ElementTree.fromstring(_member(z, name, left)).iter():
                    if isinstance(e.tag, str) and e.tag.endswith("}title") and e.text:
                        title = e.text.strip() or None
    return "\n".join(text)[:TEXT_CAP], title


def epub_text(data: bytes) -> tuple[str | None, str | None]:
    """The spine's documents in order, and dc:title."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        box = ElementTree.fromstring(_member(z, "META-INF/container.xml", INFLATE_CAP))
        opf = next(e.get("full-path") for e in box.iter() if e.tag.endswith("}rootfile"))
        root = ElementTree.fromstring(_member(z, opf, INFLATE_CAP))
        base = opf.rsplit("/", 1)[0] + "/" if "/" in opf else ""
        items = {e.get("id"): e.get("href") for e in root.iter() if e.tag.endswith("}item")}
        title = next((e.text.strip() for e in root.iter() if e.tag.endswith("}title") and e.text and e.text.strip()), None)
        out, left = [], INFLATE_CAP
        for e in [e for e in root.iter() if e.tag.endswith("}itemref")][:MAX_PARTS]:
            href = items.get(e.get("idref"))
            if href and left > 0:
                name = base + percent_decoded(href)
                if name in z.namelist():
                    body = _member(z, name, left)
                    left -= len(body)
                    out.append(html_to_text(body.decode("utf-8", "replace")))
        return "\n".join(out)[:TEXT_CAP], title


def _charset(data: bytes, name: str) -> str:
    latin = any(x in name.lower() for x in ("8859", "1252", "latin1"))
    return data.decode("latin-1") if latin else data.decode("utf-8", "replace")


def _transfer(data: bytes, how: str) -> bytes:
    if how == "base64":
        clean = re.sub(rb"[^A-Za-z0-9+/]", b"", data)
        try:
            return base64.b64decode(clean + b"=" * (-len(clean) % 4))
        except binascii.Error:
            return b""
    return quopri.decodestring(data) if how == "quoted-printable" else data


def decode_words(value: str) -> str:
    """RFC 2047 words in a header."""
    value = re.sub(r"(=\?[^?]+\?[BbQq]\?[^?]*\?=)\s+(?==\?)", r"\1", value)

    def one(m: re.Match) -> str:
        raw = m[3].encode("ascii", "replace")
        return _charset(_transfer(raw, "base64") if m[2] in "Bb" else quopri.decodestring(raw, header=True), m[1])

    return re.sub(r"=\?([^?]+)\?([BbQq])\?([^?]*)\?=", one, value)


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = data.replace(b"\r\n", b"\n").partition(b"\n\n")
    out: dict[str, str] = {}
    for line in re.sub(rb"\n[ \t]+", b" ", head).split(b"\n"):
        name, sep, value = line.decode("utf-8", "replace").partition(":")
        if sep:
            out.setdefault(name.strip().lower(), value.strip())
    return out, body


def _mail_body(head: dict[str, str], body: bytes, depth: int) -> tuple[str | None, str | None]:
    """(plain, html) of a part; attachments have neither."""
    kind = head.get("content-type", "text/plain")
    if head.get("content-disposition", "").lower().startswith("attachment"):
        return None, None
    if kind.lower().startswith("multipart/"):
        m = re.search(r'boundary="?([^";]+)', kind, re.I)
        if not m or depth >= 6:
            return None, None
        plain = markup = None
        for part in body.split(b"--" + m[1].encode())[1:]:
            if part.startswith(b"--"):
                break
            p, h = _mail_body(*_headers(part.lstrip(b"\n")), depth + 1)
            plain, markup = plain or p, markup or h
        return plain, markup
    if not kind.lower().startswith("text/"):
        return None, None
    m = re.search(r'charset="?([^";\s]+)', kind, re.I)
    text = _charset(_transfer(body, head.get("content-transfer-encoding", "").lower()), m[1] if m else "utf-8")
    return (None, text) if kind.lower().startswith("text/html") else (text, None)


def mail_text(data: bytes) -> tuple[str | None, str | None]:
    """Subject, From, To and Date lines, then the plain part, else the text of the HTML part; the subject is the title."""
    head, body = _headers(data)
    plain, markup = _mail_body(head, body, 0)
    named = [f"{n.capitalize()}: {decode_words(head[n])}" for n in ("subject", "from", "to", "date") if n in head]
    text = plain if plain is not None else html_to_text(markup) if markup is not None else ""
    return "\n".join([*named, text])[:TEXT_CAP], decode_words(head["subject"]) if "subject" in head else None


# fixed values: RTF destinations that hold no text of the document, and words that stand for characters
_SKIPPED = frozenset("fonttbl colortbl stylesheet info pict header footer headerl headerr footerl footerr object themedata listtable generator datastore xmlnstbl".split())
_SPOKEN = {"par": "\n", "line": "\n", "tab": "\t", "cell": "\t", "row": "\n", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}
_RTF = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|([^\\{}\r\n]+)|[\r\n]+", re.S)


def rtf_text(data: bytes) -> tuple[str | None, str | None]:
    """Text of an RTF document and its title; \\'hh is Windows-1252, \\uN takes its fallback away."""
    out: list[str] = []
    title: list[str] = []
    stack: list[tuple[str, int]] = []
    where, fallback, skip = "text", 1, 0
    for m in _RTF.finditer(data.decode("latin-1")):
        word, number, code, sign, brace, plain = m.groups()
        put = title if where == "title" else out if where == "text" else None
        if brace == "{":
            stack.append((where, fallback))
        elif brace == "}":
            where, fallback = stack.pop() if stack else ("text", 1)
            skip = 0
        elif word:
            if word == "u" and number:
                if put is not None:
                    put.append(chr(int(number) % 65536))
                skip = fallback
            elif word == "uc":
                fallback = int(number or 1)
            elif word == "title" and where == "skipped":
                where = "title"
            elif word in _SKIPPED:
                where = "skipped"
            elif word in _SPOKEN and put is not None:
                put.append(_SPOKEN[word])
        elif code:
            if skip:
                skip -= 1
            elif put is not None:
                put.append(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif sign:
            if sign == "*":
                where = "skipped"
            elif put is not None:
                put.append({"~": " ", "_": "-"}.get(sign, sign if sign in "\\{}" else ""))
        elif plain:
            cut, skip = min(skip, len(plain)), max(0, skip - len(plain))
            if put is not None:
                put.append(plain[cut:])
    return "".join(out)[:TEXT_CAP], "".join(title).strip() or None


def describe(data: bytes | None, ext: str) -> tuple[str | None, str | None]:
    """(text, declared title) by extension; .doc by its first bytes; null for what cannot be read."""
    try:
        if not data:
            return None, None
        if ext in OFFICE:
            return office_text(data, ext)
        if ext == "pdf":
            return pdf.read(data, TEXT_CAP)
        if ext == "epub":
            return epub_text(data)
        if ext == "eml":
            return mail_text(data)
        if ext == "rtf" or ext == "doc" and data.startswith(b"{\\rtf"):
            return rtf_text(data)
        if ext in MARKUP:
            text = plain_text(data)
            if text is None:
                return None, None
            title = re.search(r"(?is)<title[^>]*>(.*?)</title", text)
            return html_to_text(text), " ".join(html_to_text(title[1]).split()) or None if title else None
        if ext in PLAIN or ext == "doc" and not data.startswith(b"\xd0\xcf\x11\xe0"):
            return plain_text(data), None
    except Exception:  # a broken file must not end the job; its row has a null text
        return None, None
    return None, None


#: Elements that begin a page where an application has noted its layout
_BREAKS = {"docx": ("word/document.xml", "lastRenderedPageBreak"), "odt": ("content.xml", "soft-page-break"), "ods": ("content.xml", "soft-page-break"), "odp": ("content.xml", "soft-page-break")}


def pages(data: bytes | None, ext: str) -> list[str]:
    """Texts of the pages or slides of a document; none where its layout isn't known."""
    try:
        if ext == "pdf" and data:
            return list(pdf.page_texts(data))
        if ext not in ("pptx", *_BREAKS) or not data:
            return []
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if ext == "pptx":
                slides = sorted((int(m[1]), n) for n in z.namelist()[:MAX_ENTRIES] if (m := re.fullmatch(OFFICE[ext], n)))
                return [_xml_text(_member(z, n, INFLATE_CAP)) for _, n in slides[:512]]
            part, mark = _BREAKS[ext]
            out, broken = [""], False
            for _, e in ElementTree.iterparse(io.BytesIO(_member(z, part, INFLATE_CAP)), ("start",)):
                name = e.tag.rsplit("}", 1)[-1]
                if name == mark or (name == "br" and any(k.endswith("}type") and v == "page" for k, v in e.attrib.items())):
                    out.append("")
                    broken = True
                out[-1] += (e.text or "") + (" " if name in _LINES else "")
            return out if broken else []
    except Exception:  # as in describe()
        return []


def pages_with(texts, terms: list[str], accents: bool = False):
    """Numbers of the pages, from 1, whose folded texts hold all folded terms: texts is a column of an array of texts.

    accents: they count, and only capitals don't.
    """
    from ..functions import text as t

    form = F.lower if accents else t.fold
    folded = [form(F.lit(x)) for x in terms if x.strip()]
    if not folded:
        return F.array().cast("array<int>")
    hit = lambda p: F.forall(F.array(*folded), lambda w: F.contains(form(p), w))
    numbered = F.transform(texts, lambda p, k: F.when(hit(p), k + 1))
    return F.filter(numbered, lambda k: k.isNotNull())


def prominent(lines: list[tuple[str, float]], join: bool = True) -> list[str]:
    """Lines set larger than the body, the largest first, at most eight: (text, size) in reading order.

    The body is the size, within three in a hundred, that most characters are set in. Lines of one size that follow
    each other are one. Where three or more share the largest size they are headings of sections, and none is taken.
    """
    same = lambda a, b: abs(a - b) <= 0.03 * max(a, b)
    rows = [(" ".join(t.split()), s) for t, s in lines if t.split() and 0 < s < float("inf")]
    weight: list[list[float]] = []
    for t, s in rows:
        held = next((w for w in weight if same(w[0], s)), None)
        if held is None:
            weight.append([s, len(t)])
        else:
            held[1] += len(t)
    if not weight:
        return []
    body = max(reversed(weight), key=lambda w: w[1])[0]
    runs: list[tuple[str, float]] = []
    for t, s in rows:
        if join and runs and same(runs[-1][1], s):
            runs[-1] = (f"{runs[-1][0]} {t}" if len(runs[-1][0]) < 400 else runs[-1][0], runs[-1][1])
        else:
            runs.append((t, s))
    large = sorted((r for r in runs if r[1] >= 1.15 * body), key=lambda r: -r[1])
    if large and sum(same(large[0][1], s) for _, s in large) >= 3:
        return []
    return [t for t, _ in large[:8]]


#: Styles of paragraphs that are set as titles, by name in lower case without spaces
_TITLES = frozenset(["title", "heading1", "titulo", "titre", "titel"])


def title_lines(data: bytes | None, ext: str) -> list[str]:
    """Lines that an office document sets as titles: by the style of a paragraph, or the title's place on the first slide."""
    try:
        if not data or ext not in OFFICE or ext in ("xlsx", "ods"):
            return []
        local = lambda x: x.rsplit("}", 1)[-1]
        said = lambda e: " ".join("".join(t for t in e.itertext()).split())
        attr = lambda e, name: next((v for k, v in e.attrib.items() if local(k) == name), "")
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            part = {"docx": "word/document.xml", "pptx": "ppt/slides/slide1.xml"}.get(ext, "content.xml")
            root = ElementTree.fromstring(_member(z, part, INFLATE_CAP))
        out = []
        for e in root.iter():
            name = local(e.tag)
            if ext == "docx" and name == "p":
                style = next((attr(x, "val") for x in e.iter() if local(x.tag) == "pStyle"), "")
                good = style.lower().replace(" ", "") in _TITLES
            elif ext == "pptx" and name == "sp":
                good = any(local(x.tag) == "ph" and attr(x, "type") in ("title", "ctrTitle") for x in e.iter())
            elif ext == "odp":
                good = name == "frame" and attr(e, "class") == "title"
            else:
                good = (name == "h" and attr(e, "outline-level") == "1") or (name == "p" and attr(e, "style-name").lower().replace("_20_", "") in _TITLES)
            if good and (line := said(e)):
                out.append(line)
            if len(out) == 8 or (out and ext in ("pptx", "odp")):
                break
        return out
    except Exception:  # as in describe()
        return []


MEDIA = "path string, kind string, width bigint, height bigint, seconds double"


def media_of(files: DataFrame) -> DataFrame:
    """(path, kind, width, height, seconds) of files(path, content); null for what the first bytes don't say."""
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("seconds", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            rows = [{"path": p, **media(c.as_py())} for p, c in zip(batch.column(0).to_pylist(), batch.column(1))]
            yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    return files.select("path", "content").mapInArrow(run, MEDIA)


def media(data: bytes | None) -> dict[str, object]:
    """Kind of a file of sound or pictures, width and height of PNG, GIF, JPEG and BMP, seconds of WAV; else nothing."""
    import struct

    data = data or b""
    if data.startswith(b"\x89PNG\r\n\x1a\n") and len(data) >= 24:
        return {"kind": "image", "width": int.from_bytes(data[16:20], "big"), "height": int.from_bytes(data[20:24], "big")}
    if data[:4] == b"GIF8" and len(data) >= 10:
        return {"kind": "image", "width": int.from_bytes(data[6:8], "little"), "height": int.from_bytes(data[8:10], "little")}
    if data[:2] == b"BM" and len(data) >= 26:
        return {"kind": "image", "width": int.from_bytes(data[18:22], "little"), "height": abs(struct.unpack("<i", data[22:26])[0])}
    if data[:3] == b"\xff\xd8\xff":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                return {"kind": "image", "height": int.from_bytes(data[at + 5 : at + 7], "big"), "width": int.from_bytes(data[at + 7 : at + 9], "big")}
            at += 2 + size
        return {"kind": "image"}
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        at, rate, size = 12, 0, 0
        while at + 8 <= len(data):
            name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if name == b"fmt ":
                rate = int.from_bytes(data[at + 16 : at + 20], "little")
            if name == b"data":
                size = n
            at += 8 + n + n % 2
        return {"kind": "audio", "seconds": size / rate} if rate else {"kind": "audio"}
    return {}


def walk(spark: SparkSession, roots: list[str], hidden: bool = False) -> DataFrame:
    """(path, mtime, size, content) of the files below roots, read as they are asked for; hidden ones are left out.

    A folder that is a root itself may lie below a hidden one; only what is below the root counts.
    """
    out = None
    for root in roots:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        plain = F.regexp_replace("path", r"^file:/+", "/")
        below = F.substring(plain, len(root.rstrip("/")) + 1, 1 << 20)
        rows = rows.select(plain.alias("path"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"), "content", below.alias("below"))
        rows = (rows if hidden else rows.where(~paths.is_hidden(F.col("below")))).drop("below")
        out = rows if out is None else out.unionByName(rows)
    return out.dropDuplicates(["path"])


def extract(files: DataFrame, cap: int = TEXT_CAP) -> DataFrame:
    """(path, text, title, prominent) of files(path, content), as Spark's binaryFile source reads them. cap: characters of a text.

    title: what the file declares; prominent: lines that it sets as titles.
    A file without an extension is read as what its first bytes are, text or PDF.
    """
    sniffed = files.select("path", "content", mime.sniff(F.col("content")).alias("said"))

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for path, data, said in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                name = path.rsplit("/", 1)[-1]
                ext = name.rsplit(".", 1)[-1].lower() if "." in name[1:] else ""
                if not ext and ((said or "").startswith("text/") or said == "application/pdf"):
                    ext = {"text/html": "html", "application/pdf": "pdf"}.get(said, "txt")
                text, title = describe(data.as_py(), ext)
                rows.append({"path": path, "text": None if text is None else text[:cap], "title": title, "prominent": title_lines(data.as_py(), ext)})
            yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    schema = pa.schema([("path", pa.string()), ("text", pa.string()), ("title", pa.string()), ("prominent", pa.list_(pa.string()))])
    return sniffed.mapInArrow(run, "path string, text string, title string, prominent array<string>")
