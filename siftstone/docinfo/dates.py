"""The date that identifies a document, by the words around each date in it."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Mapping
from dataclasses import dataclass

from .months import fold
from .words import ENGLISH, IBERIAN, fold_lower, norm

# fixed values: words before a date that rule it out as the document's own, in normalised text
AGAINST = re.compile(
    r"venc|validade|valid[ao] ate|nasc|\bdn\b|inicio|termino|prazo|\bate\b|a partir|periodo|referen|leitura|coleta|vigen|proxim|previst|lancamento|entrega"
    r"|validez|valid[oa] hasta|nacim|nacid|plazo|\bhasta\b|\bfin\b"
    r"|\bdue\b|expir|valid until|valid through|birth|born|\bstart|\bend\b|deadline|\buntil\b|\bthrough\b|effective|renew|\bnext\b|\bperiod\b"
    r"|original|de origem|anterior|\bsu[ae]? (carta|oficio|escrito|solicitud|mensagem|e ?mail)|solicitud"
    r"|\byour\b|previous|\bprior\b|preceding|in response|beginning|commenc|launch"
)
# fixed values: an article's history
HISTORY = re.compile(r"submet|submitted|received|recebid|recibid|aceit[oa]|accepted|aceptad[oa]")
# fixed values: words before a date that make it the document's own
FOR = re.compile(
    r"emiss|emitid|\bdata\b|assinad|reuniao|realizad|publicad|enviad|aprovad|sessao|\bem\b$"
    r"|\bfecha\b|emision|firmad|celebrad|\bsesion\b"
    r"|\bdated?\b|issued|signed|meeting|\bheld\b|published|\bsent\b|approved|session|\bon\b$|\bas of\b|entered into|executed"
    r"|(?:^|(?:[a-z]{3,}|\d+) )(?:(?:segunda|terca|quarta|quinta|sexta) feira|sabado|domingo"
    r"|lunes|martes|miercoles|jueves|viernes"
    r"|monday|tuesday|wednesday|thursday|friday|saturday|sunday)$"
)
# fixed values: stamps of electronic signatures, and of copies
STAMP = re.compile(r"eletronicamente|electronicamente|firmado por|firma electronica|digitally signed|signed by")
COPY_STAMP = re.compile(r"(?i)downloaded|accessed|retrieved|baixado|acess[oa]|descargado|consultado|recuperado|\.pdf (?:by|por)\b")
# fixed values: the header of a printed page
PRINT_HEADER = re.compile(r"^\s*\d{1,2}/\d{1,2}/\d{2,4},?\s+\d{1,2}:\d{2}\s*$")
# fixed values: documents that a person is described by
IDENTITY = re.compile(r"habilitacao|carteira de identidade|\brg\b|passaporte|passport|driver s license")
# fixed values: acts that are cited by number and date
CITED_ACT = re.compile(
    r"\b(?:lei|decreto|portaria|resolucao|instrucao normativa|medida provisoria|emenda|acordao|deliberacao"
    r"|oficio|despacho|memorando|parecer|nota tecnica|contrato|convenio"
    r"|ley|orden|reglamento|resolucion|directiva|expediente"
    r"|act|law|order|regulation|memorandum|contract)\b"
    r"(?:(?: [a-z0-9]+){0,6}? (?:n[o]? )?\d[\d ]*(?:[a-z]+ ){0,6}de|(?: [a-z]+)? de)$"
)
#: A place and a comma, and a word of time at most, before a date
PLACE = re.compile(r"^\s*([^\W\d_][\w .'/-]*?)(,\s*[A-Z]{2})?[,，、]\s*((em|le|den|am|el|on|the|a)\s+)?$")
UNCASED = re.compile(r"^[֐-׿぀-ヿ一-鿿가-힯]")

# fixed values: Portuguese and Spanish number words
UNITS = {
    "um": 1, "uma": 1, "un": 1, "uno": 1, "una": 1, "primeiro": 1, "primero": 1, "dois": 2, "duas": 2, "dos": 2, "tres": 3,
    "quatro": 4, "cuatro": 4, "cinco": 5, "seis": 6, "sete": 7, "siete": 7, "oito": 8, "ocho": 8, "nove": 9, "nueve": 9,
    "dez": 10, "diez": 10, "onze": 11, "once": 11, "doze": 12, "doce": 12, "treze": 13, "trece": 13, "catorze": 14, "quatorze": 14, "catorce": 14,
    "quinze": 15, "quince": 15, "dezesseis": 16, "dezasseis": 16, "dieciseis": 16, "dezessete": 17, "dezassete": 17, "diecisiete": 17,
    "dezoito": 18, "dieciocho": 18, "dezenove": 19, "dezanove": 19, "diecinueve": 19, "vinte": 20, "veinte": 20,
    "veintiun": 21, "veintiuno": 21, "veintidos": 22, "veintitres": 23, "veinticuatro": 24, "veinticinco": 25, "veintiseis": 26, "veintisiete": 27, "veintiocho": 28, "veintinueve": 29,
    "trinta": 30, "treinta": 30, "quarenta": 40, "cuarenta": 40, "cinquenta": 50, "cincuenta": 50, "sessenta": 60, "sesenta": 60, "setenta": 70, "oitenta": 80, "ochenta": 80, "noventa": 90,
    "cem": 100, "cento": 100, "cien": 100, "ciento": 100, "duzentos": 200, "doscientos": 200, "trezentos": 300, "trescientos": 300, "quatrocentos": 400, "cuatrocientos": 400,
    "quinhentos": 500, "quinientos": 500, "seiscentos": 600, "seiscientos": 600, "setecentos": 700, "setecientos": 700, "oitocentos": 800, "ochocientos": 800, "novecentos": 900, "novecientos": 900,
}
#: Candidates that are judged at most: the first and last halves of them
JUDGED = 1000
_FAMILIES = (
    # (pattern, group of year, of month, of day, whether the month is a name)
    (re.compile(r"\b(\d{4})-(\d{2})-(\d{2})\b"), 1, 2, 3, False),
    (re.compile(r"\b(\d{1,2})\s?[.ºo°]?\s+(?:(?:de|of|De|Of|DE|OF)\s+)?([^\W\d_]+)\.?,?\s+(?:(?:de|del|De|Del|DE|DEL)\s+)?(\d{4})\b"), 3, 2, 1, True),
    (re.compile(r"\b([^\W\d_]+)\.?\s+(\d{1,2})(?:st|nd|rd|th|ST|ND|RD|TH)?,?\s+(\d{4})\b"), 3, 1, 2, True),
    (re.compile(r"\b(\d{4})\.\s+([^\W\d_]+)\s+(\d{1,2})\b"), 1, 2, 3, True),
    (re.compile(r"(\d{4})\s*[年년]\s*(\d{1,2})\s*[月월]\s*(\d{1,2})\s*[日일]"), 1, 2, 3, False),
)
_NUMERIC = re.compile(r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\b")
_FORMAL = re.compile(r"(?i)\b(?:aos|a los|this|on the)\s+((?:[a-zÀ-ÿ\d]+[ -]){0,4}?[a-zÀ-ÿ\d]+?)(?:st|nd|rd|th)?\s+d(?:ias?|ías?|ay)\s+(?:do\s+m[eê]s\s+de|del\s+mes\s+de|de|of)\s+([^\W\d_]+),?\s+(?:do\s+ano\s+de|del\s+a[ñn]o|de|of)?\s*")


@dataclass(frozen=True)
class Date:
    start: int
    end: int
    iso: str
    formal: bool = False


def exists(year: int, month: int, day: int) -> bool:
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    days = {4: 30, 6: 30, 9: 30, 11: 30, 2: 29 if leap else 28}.get(month, 31)
    return 1000 <= year <= 2999 and 1 <= month <= 12 and 1 <= day <= days


def number(words: list[str]) -> int | None:
    """Value of a number in digits, or in Portuguese or Spanish words."""
    if len(words) == 1 and words[0].isascii() and words[0].isdigit():
        return int(words[0])
    total = part = 0
    said = False
    for w in map(fold_lower, words):
        if w in ("e", "y"):
            continue
        if w == "mil":
            total, part, said = total + max(part, 1) * 1000, 0, True
        elif w in UNITS:
            part, said = part + UNITS[w], True
        else:
            return None
    return total + part if said else None


def year_at(text: str, at: int) -> tuple[int, int] | None:
    """(year, where it ends) of the year that begins at a place, in four digits or up to eight words."""
    words: list[tuple[str, int]] = []
    for m in re.compile(r"\s*(\S+)").finditer(text, at, at + 200):
        bare = m[1].rstrip(",.;:")
        if not words and re.fullmatch(r"[0-9]{4}", bare):
            return int(bare), m.end()
        if len(words) == 8 or (bare not in ("e", "y") and number([bare]) is None):
            break
        words.append((bare, m.end()))
        if bare != m[1]:
            break
    end = words[-1][1] if words else at
    while words and words[-1][0] in ("e", "y"):
        words.pop()
    got = number([w for w, _ in words])
    return (got, end) if got is not None and 1000 <= got <= 2999 else None


def is_english(text: str) -> bool:
    """By function words in the first 4000 characters."""
    words = norm(text[:4000]).split(" ")
    en, ib = sum(w in ENGLISH for w in words), sum(w in IBERIAN for w in words)
    return en >= 5 and en > 2 * ib


class Reader:
    """Finds dates with a table of month names."""

    def __init__(self, months: Mapping[str, int]) -> None:
        self.months = months

    def month(self, name: str) -> int | None:
        folded = fold(name)
        got = self.months.get(folded)
        # Hebrew puts its preposition before the name, as one letter
        return self.months.get(folded[1:]) if got is None and folded[:1] in ("ב", "ל") else got

    def dates(self, text: str) -> list[Date]:
        """All dates that exist, in the order of their places."""
        out = self._numeric(text)
        for pattern, y, m, d, named in _FAMILIES:
            for x in pattern.finditer(text):
                month = self.month(x[m]) if named else int(x[m])
                if month and exists(int(x[y]), month, int(x[d])):
                    out.append(Date(x.start(), x.end(), f"{int(x[y]):04}-{month:02}-{int(x[d]):02}"))
        for x in _FORMAL.finditer(text):
            words = re.split("[ -]", x[1])
            day, month, year = number(words) if len(words) <= 5 else None, self.month(x[2]), year_at(text, x.end())
            if day and month and year and exists(year[0], month, day):
                out.append(Date(x.start(), year[1], f"{year[0]:04}-{month:02}-{day:02}", True))
        return sorted(out, key=lambda d: d.start)

    def _numeric(self, text: str) -> list[Date]:
        """Day first; in English text a date that reads both ways counts only if others settle which."""
        found = [(x, int(x[1]), int(x[2]), int(x[3])) for x in _NUMERIC.finditer(text)]
        if not found:
            return []
        order = "day"
        if is_english(text):
            proof = {"day" for _, a, b, _ in found if a > 12 >= b} | {"month" for _, a, b, _ in found if b > 12 >= a}
            order = proof.pop() if len(proof) == 1 else None
        out = []
        for x, a, b, y in found:
            first = "day" if a > 12 else "month" if b > 12 else order
            if first is None:
                continue
            day, month = (a, b) if first == "day" else (b, a)
            if exists(y, month, day):
                out.append(Date(x.start(), x.end(), f"{y:04}-{month:02}-{day:02}"))
        return out

    def is_date_line(self, line: str) -> bool:
        """Whether a line is little more than a date, or a month and a year."""
        line = line.strip()
        words = re.findall(r"[^\W_]+", line)
        months = [w for w in words if self.month(w)]
        rest = [w for w in words if not self.month(w) and not re.fullmatch("[0-9]+", w) and fold_lower(w) not in ("de", "del", "of", "the")]
        if months and not rest:
            return True
        size = len(line.encode())
        return any(len(line[d.start : d.end].encode()) * 10 >= size * 7 for d in self.dates(line))

    def own(self, text: str) -> tuple[str, int] | None:
        """(date, evidence) of the document itself: the best by evidence, then the first; at least 1.

        Without one it is that of the first signature stamp, with evidence 0.
        """
        all_ = self.dates(text)
        if len(all_) > JUDGED:
            all_ = all_[: JUDGED // 2] + all_[-JUDGED // 2 :]
        if not all_:
            return None
        page = _Page(text)
        best: tuple[int, float, str] | None = None
        stamp: str | None = None
        for d in all_:
            window = text[max(0, d.start - 160) : d.start]
            copies = list(COPY_STAMP.finditer(window))
            if PRINT_HEADER.match(page.line(d.start)) or (copies and not self.dates(window[copies[-1].end() :])):
                continue
            if STAMP.search(norm(window)):
                stamp = stamp or d.iso
                continue
            place = page.share(d.start)
            key = (page.evidence(d) + (not 0.15 <= place <= 0.85), -place, d.iso)
            if best is None or key > best:
                best = key
        if best is not None and best[0] >= 1:
            return best[2], best[0]
        return (stamp, 0) if stamp else None


class _Page:
    """A text with its lines, for what stands around a place."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.bytes = max(1, len(text.encode()))
        filled = [s for s, e in zip(self.starts, [*self.starts[1:], len(text) + 1]) if text[s : e - 1].strip()]
        self.title_end = filled[2] if len(filled) > 2 else len(text)
        self.known: tuple[int, int] = (0, 0)

    def line_start(self, at: int) -> int:
        return self.starts[bisect_right(self.starts, at) - 1]

    def line(self, at: int) -> str:
        k = bisect_right(self.starts, at)
        return self.text[self.starts[k - 1] : self.starts[k] - 1 if k < len(self.starts) else len(self.text)]

    def share(self, at: int) -> float:
        """Where a place lies, as a share of the bytes. Places are asked for in order."""
        seen, size = self.known
        if at < seen:
            seen, size = 0, 0
        size += len(self.text[seen:at].encode())
        self.known = (at, size)
        return size / self.bytes

    def scope(self, at: int, alone: bool = False) -> int:
        """Where the words begin that say what a date is of: its line, or the line above if two words or fewer come before it.

        alone: the date's own line says what it is of, so that a line above it is left out if it is of another paragraph.
        """
        start = self.line_start(at)
        if len(self.text[start:at].split(None, 3)) > 2:
            return start
        if alone and start > 1 and not self.line(start - 1).strip():
            return start
        above = self.text[:start].rstrip()
        return above.rfind("\n") + 1

    def evidence(self, d: Date) -> int:
        text, start = self.text, self.line_start(d.start)
        before = text[start : d.start]
        signed = d.formal or self._place_alone(before)
        words = text[self.scope(d.start, signed) : d.start]
        near = norm(words[-35:])
        score = 0
        if AGAINST.search(near) or IDENTITY.search(norm(words[-200:])):
            score -= 3
        if CITED_ACT.search(norm(text[max(0, d.start - 120) : d.start])):
            own = CITED_ACT.search(norm(before)) if len(before.encode()) <= 300 and start <= self.title_end and before.lstrip()[:1].isalpha() else None
            score += 3 if own and own.start() == 0 else -3
        if FOR.search(near) and not HISTORY.search(near):
            score += 2
        if signed:
            score += 3
        rest = text[d.end :].split("\n", 1)[0] if d.end < len(text) else ""
        if not before.strip() and not rest.strip(" \t\r.\x0b\x0c "):
            score += 2
        return score

    @staticmethod
    def _place_alone(before: str) -> bool:
        m = PLACE.match(before) if len(before.encode()) <= 512 else None
        if not m:
            return False
        place = m[1]
        return len(place) <= 41 and (bool(UNCASED.match(place)) or (place[0].isupper() and len(place) >= 3))
