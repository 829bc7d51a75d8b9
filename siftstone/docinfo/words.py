"""Words and lines of a text as plain Python values, for what columns can't say."""

from __future__ import annotations

import re
import unicodedata

from ..functions.text import ENGLISH, IBERIAN

__all__ = ["ENGLISH", "IBERIAN", "content_lines", "fold_lower", "lines", "norm", "word_count"]

_EDGE = " \t\r\n\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  ​‌‍⁠﻿"
_MULTI = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ł": "l", "ø": "o", "đ": "d", "ð": "d", "ı": "i"}


class _Folded(dict):
    """What a character folds to. Each is decomposed once; the order of marks, which a whole text's form settles, is of no matter, as they go."""

    def __missing__(self, code: int) -> str:
        self[code] = out = "".join(_MULTI.get(c, c) for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        return out


_FOLDED = _Folded()


def fold_lower(text: str) -> str:
    """Lower case, Latin letters without accents, superscripts and ligatures as plain ones."""
    low = text.lower()
    return low if low.isascii() else low.translate(_FOLDED)


def norm(text: str) -> str:
    """Folded words joined by single spaces."""
    return " ".join(re.findall(r"\w+", fold_lower(text)))


def lines(text: str) -> list[str]:
    return text.splitlines()


def content_lines(text: str) -> list[str]:
    return [x for x in (line.strip(_EDGE) for line in lines(text)) if x]


def word_count(text: str) -> int:
    return len(text.split())
