"""A few sentences of a document that stand for it."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

from .words import lines, norm, word_count

#: Characters and sentences that are read, words that are shown, and how much likeness counts against a sentence
HEAD, SENTENCES, WORDS, DIVERSITY = 100_000, 400, 90, 0.4
#: List items and labels of fields
LABEL = re.compile(r"^(?:[-•*]|\d+[.)]\s|([A-ZÀ-Ý][\wÀ-ÿ /]*:)\s)")
_BREAK = re.compile(r"(?<=[.!?])\s+(?=[0-9A-ZÀ-Ý\"“(])")


def is_label(line: str) -> bool:
    m = LABEL.match(line)
    return bool(m) and (m[1] is None or len(m[1]) <= 27)


def sentences(text: str) -> list[str]:
    """Sentences of six words or more, mostly in small letters; wrapped lines are joined first."""
    paragraphs: list[list[str]] = [[]]
    for line in map(str.strip, lines(text)):
        last = paragraphs[-1]
        open_ = bool(last) and last[-1][-1] not in ".!?:;"
        if not line:
            paragraphs.append([])
        elif open_ and not is_label(line) and (line[0].islower() or word_count(" ".join(last)) >= 8):
            last.append(line)
        else:
            paragraphs.append([line])
    out = []
    for p in paragraphs:
        for s in _BREAK.split(" ".join(p)):
            letters = sum(map(str.isalpha, s))
            if word_count(s) >= 6 and letters and 2 * sum(map(str.isupper, s)) < letters and not is_label(s):
                out.append(s.strip())
    return out


def structured(text: str) -> bool:
    """Whether over three lines in five have six words at most."""
    filled = [x for x in lines(text) if x.strip()]
    return sum(word_count(x) <= 6 for x in filled) * 5 > len(filled) * 3 or not filled


def weights(said: list[str]) -> np.ndarray:
    """(sentences, terms): 1 + ln of counts by the smoothed inverse frequency among the sentences, of unit length."""
    counts = [Counter(w for w in norm(s).split(" ") if len(w) >= 2) for s in said]
    terms = sorted(set().union(*counts))
    at = {t: k for k, t in enumerate(terms)}
    x = np.zeros((len(said), len(terms)))
    for k, c in enumerate(counts):
        for w, n in c.items():
            x[k, at[w]] = 1 + math.log(n)
    df = (x > 0).sum(axis=0)
    x *= np.log((1 + len(said)) / (1 + df)) + 1
    # unit vectors are divided once more by their length and a little, as recorded results are
    for more in (0.0, 1e-9):
        size = np.sqrt((x * x).sum(axis=1)) + more
        x /= np.where(size > 0, size, 1)[:, None]
    return x


def extract(text: str) -> str | None:
    """The sentences closest to the whole, each as unlike those before it as may be, in the order of the text."""
    text = text[:HEAD]
    said = sentences(text)[:SENTENCES]
    if len(said) < 2 or structured(text):
        return None
    x = weights(said)
    centre = x.mean(axis=0)
    size = math.sqrt(float(centre @ centre))
    near = x @ (centre / (size or 1.0))
    likeness = np.zeros(len(said))
    left = np.ones(len(said), bool)
    words = 0
    while left.any():
        score = np.round(((1 - DIVERSITY) * near - DIVERSITY * likeness) * 1e9)
        k = int(np.argmax(np.where(left, score, -np.inf)))
        n = word_count(said[k])
        if words and words + n > WORDS:
            break
        left[k] = False
        words += n
        likeness = np.maximum(likeness, x @ x[k])
    return " ".join(s for s, kept in zip(said, ~left) if kept)
