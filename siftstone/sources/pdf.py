"""Text of PDF files whose fonts say what their codes mean; encrypted files and scans have none.

Objects are found by scanning the file, not by its cross-reference table, so a damaged table does no harm. Streams are
inflated one at a time and within a budget.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Any

#: Bytes that are inflated of one file, pages that are read, and depth of its trees
BUDGET, MAX_PAGES, DEPTH = 64 << 20, 5000, 40
_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")
_TOKEN = re.compile(rb"\s*(?:%[^\r\n]*[\r\n]\s*)*(<<|>>|\[|\]|/[^\s()<>\[\]{}/%]*|\(|<[0-9A-Fa-f\s]*>|[^\s()<>\[\]{}/%]+|[{}()<>])")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    pass


class Operator(bytes):
    pass


class Ref(tuple):
    pass


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """(string, where it ends) of a string in parentheses whose first one is before at."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            e = data[at : at + 1]
            if e.isdigit():
                m = re.compile(rb"[0-7]{1,3}").match(data, at)
                if m:
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                    continue
            at += 1
            if e not in b"\r\n":
                out += _ESCAPES.get(e, e)
            elif e == b"\r" and data[at : at + 1] == b"\n":
                at += 1
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def _tokens(data: bytes, at: int = 0) -> Iterator[tuple[Any, int]]:
    """(value, where it ends): names, numbers, strings, brackets and operators."""
    while m := _TOKEN.match(data, at):
        t, at = m[1], m.end()
        if t == b"(":
            value, at = _literal(data, at)
            yield value, at
        elif t[:1] == b"/":
            yield Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), t[1:]).decode("latin-1")), at
        elif t[:1] == b"<" and t != b"<<" and len(t) > 1:
            digits = re.sub(rb"\s", b"", t[1:-1])
            yield bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
        elif re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", t):
            yield (float(t) if b"." in t else int(t)), at
        else:
            yield Operator(t), at


def _value(data: bytes, at: int) -> tuple[Any, int]:
    """The object that begins at a place, and where it ends."""
    stack: list[list] = [[]]
    kinds: list[bytes] = []
    for token, end in _tokens(data, at):
        if isinstance(token, Operator):
            if token in (b"<<", b"["):
                stack.append([])
                kinds.append(bytes(token))
            elif token in (b">>", b"]") and kinds:
                items, kind = stack.pop(), kinds.pop()
                stack[-1].append(dict(zip(items[::2], items[1::2])) if kind == b"<<" else items)
            elif token == b"R" and len(stack[-1]) >= 2:
                gen, num = stack[-1].pop(), stack[-1].pop()
                stack[-1].append(Ref((num, gen)))
            elif not kinds:
                return (stack[0][0] if stack[0] else None), end - len(token)
            else:
                stack[-1].append({b"true": True, b"false": False}.get(bytes(token)))
        else:
            stack[-1].append(token)
        if not kinds and stack[0] and not isinstance(stack[0][-1], int):
            return stack[0][-1], end
        if len(kinds) > DEPTH:
            break
    return (stack[0][0] if stack[0] else None), at


class File:
    def __init__(self, data: bytes) -> None:
        self.data, self.left = data, BUDGET
        # of objects with one number the last in the file counts
        self.at = {int(m[1]): m.end() for m in _OBJECT.finditer(data)}
        self.packed: dict[int, Any] = {}
        self.known: dict[int, Any] = {}
        self.streams: dict[int, int] = {}
        for n in list(self.at):
            if b"ObjStm" in data[self.at[n] : self.at[n] + 400]:
                self._unpack(n)

    def get(self, x: Any) -> Any:
        for _ in range(DEPTH):
            if not isinstance(x, Ref):
                return x
            x = self._object(x[0])
        return None

    def _object(self, n: int) -> Any:
        if n not in self.known:
            if n in self.at:
                self.known[n], self.streams[n] = _value(self.data, self.at[n])
            else:
                self.known[n] = self.packed.get(n)
        return self.known[n]

    def stream(self, ref: Any) -> bytes:
        """Content of a stream, inflated; empty for filters that aren't known here."""
        if not isinstance(ref, Ref) or not isinstance(said := self._object(ref[0]), dict) or ref[0] not in self.streams:
            return b""
        m = re.compile(rb"\s*stream\r?\n").match(self.data, self.streams[ref[0]])
        if not m:
            return b""
        size = self.get(said.get("Length"))
        end = m.end() + size if isinstance(size, int) and self.data[m.end() + size : m.end() + size + 20].lstrip().startswith(b"endstream") else self.data.find(b"endstream", m.end())
        raw = self.data[m.end() : end if end >= 0 else len(self.data)]
        filters = self.get(said.get("Filter"))
        filters = [] if filters is None else filters if isinstance(filters, list) else [filters]
        for f in map(self.get, filters):
            if f != "FlateDecode" or self.get(said.get("DecodeParms")):
                return b""
            raw = zlib.decompressobj().decompress(raw, max(self.left, 1))
        self.left -= len(raw)
        return raw if self.left > 0 else b""

    def _unpack(self, n: int) -> None:
        """Objects that lie together in a stream: pairs of number and place, then the objects."""
        said = self._object(n)
        if not isinstance(said, dict) or said.get("Type") != "ObjStm":
            return
        body, first = self.stream(Ref((n, 0))), self.get(said.get("First"))
        numbers = [int(x) for x in body[: first or 0].split() if x.isdigit()]
        for num, place in zip(numbers[::2], numbers[1::2]):
            self.packed[num] = _value(body, first + place)[0]

    def pages(self) -> Iterator[tuple[dict, dict]]:
        """(page, its resources) in order."""
        every = [*self.packed, *self.at]
        root = next((o for n in every if isinstance(o := self._object(n), dict) and o.get("Type") == "Catalog"), None)
        stack = [(root.get("Pages"), {}, 0)] if root else []
        seen, n = set(), 0
        while stack and n < MAX_PAGES:
            ref, above, depth = stack.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or depth > DEPTH or (isinstance(ref, Ref) and ref in seen):
                continue
            seen.add(ref if isinstance(ref, Ref) else id(node))
            own = self.get(node.get("Resources")) or above
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                stack += [(k, own, depth + 1) for k in reversed(kids)]
            else:
                n += 1
                yield node, own

    def fonts(self, resources: dict) -> dict[str, dict[bytes, str] | None]:
        """For each font what its codes mean; null if it doesn't say."""
        out = {}
        for name, ref in (self.get(resources.get("Font")) or {}).items():
            font = self.get(ref)
            out[name] = _cmap(self.stream(font["ToUnicode"])) if isinstance(font, dict) and "ToUnicode" in font else None
        return out

    def title(self) -> str | None:
        m = re.search(rb"/Info\s+(\d+)\s+\d+\s+R", self.data)
        info = self._object(int(m[1])) if m else None
        raw = self.get(info.get("Title")) if isinstance(info, dict) else None
        return (_plain(raw).strip() or None) if isinstance(raw, bytes) else None


def _plain(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")


def _cmap(data: bytes) -> dict[bytes, str]:
    """Codes and their text, of a font's table of characters and ranges."""
    out: dict[bytes, str] = {}
    text = lambda x: x.decode("utf-16-be", "replace")
    for kind, body in re.findall(rb"begin(bfchar|bfrange)(.*?)end\1", data, re.S):
        items: list = []
        many: list | None = None
        for token, _ in _tokens(body):
            if token == b"[" and isinstance(token, Operator):
                many = []
            elif token == b"]" and isinstance(token, Operator):
                items.append(many)
                many = None
            elif isinstance(token, bytes) and not isinstance(token, Operator):
                (items if many is None else many).append(token)
        step = 2 if kind == b"bfchar" else 3
        for k in range(0, len(items) - step + 1, step):
            lo, to = items[k], items[k + step - 1]
            if step == 2:
                out[lo] = text(to)
                continue
            first, last = int.from_bytes(lo, "big"), int.from_bytes(items[k + 1], "big")
            for j in range(min(last - first + 1, 65536)):
                code = (first + j).to_bytes(len(lo), "big")
                if isinstance(to, list):
                    if j < len(to):
                        out[code] = text(to[j])
                else:
                    out[code] = text(to[:-2]) + chr(int.from_bytes(to[-2:], "big") + j)
    return out


def _decoded(raw: bytes, table: dict[bytes, str] | None) -> str:
    if not table:
        return _plain(raw)
    size = max(map(len, table))
    return "".join(table.get(raw[k : k + size], "") for k in range(0, len(raw), size))


def _page_text(content: bytes, fonts: dict[str, dict[bytes, str] | None]) -> str:
    """Strings that are shown, with a line's end where the place moves down and a space where it jumps ahead."""
    out: list[str] = []
    stack: list = []
    table: dict[bytes, str] | None = None
    line = 0.0
    lists: list[list] = []
    for token, _ in _tokens(content):
        if not isinstance(token, Operator):
            (lists[-1] if lists else stack).append(token)
            continue
        if token == b"[":
            lists.append([])
            continue
        if token == b"]":
            if lists:
                stack.append(lists.pop())
            continue
        if token == b"Tf" and len(stack) >= 2:
            table = fonts.get(stack[-2])
        elif token in (b"Td", b"TD") and len(stack) >= 2 and isinstance(stack[-1], (int, float)):
            out.append("\n" if stack[-1] else " ")
        elif token == b"Tm" and len(stack) >= 6 and isinstance(stack[-1], (int, float)):
            out.append(" " if stack[-1] == line else "\n")
            line = stack[-1]
        elif token in (b"T*", b"ET"):
            out.append("\n")
        if token in (b"'", b'"'):
            out.append("\n")
        if token in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes):
            out.append(_decoded(stack[-1], table))
        elif token == b"TJ" and stack and isinstance(stack[-1], list):
            for x in stack[-1]:
                out.append(_decoded(x, table) if isinstance(x, bytes) else " " if isinstance(x, (int, float)) and x < -200 else "")
        stack.clear()
    lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def page_texts(data: bytes) -> Iterator[str]:
    """The text of each page in order."""
    file = File(data)
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        return
    for page, resources in file.pages():
        parts = file.get(page.get("Contents"))
        parts = parts if isinstance(parts, list) else [page.get("Contents")]
        yield _page_text(b"\n".join(map(file.stream, parts)), file.fonts(resources))


def read(data: bytes, cap: int) -> tuple[str | None, str | None]:
    """(text, declared title) of a file; null without text. cap: characters that are kept."""
    out, size = [], 0
    for text in page_texts(data):
        out.append(text)
        size += len(text)
        if size >= cap:
            break
    return ("\n\n".join(out)[:cap] if size else None), File(data).title()
