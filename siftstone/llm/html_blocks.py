"""HTML extraction by a recurrent block labeller.

A page becomes a sequence of leaf blocks (text between block-level tags) with their tag paths. A bidirectional LSTM in
numpy reads, for each block, a hashed vector of its tag path (names, class and id words) and one of its words with a
few counts, and says for every block whether it belongs to the main text, with the whole page as context.

It is trained here, on pages that a seeded generator lays out: the generator knows which blocks are main text, and
draws markup, class names, order and wording from wide ranges, so that no page of the corpus is needed.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .html_pages import generated_page

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
#: Elements whose content a browser doesn't show as text of the page
RAW = frozenset("script style noscript template iframe select textarea title canvas audio video".split())
#: Innermost names and words of a path that are read; the depth is read beside them
PATH_WORDS = 64
#: Elements that stand within a line of text
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the first is closed by a start tag of the second
_BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSES = {"p": _BLOCKS, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}
#: White space of HTML and Unicode, joined to one space
_SPACE = re.compile(r"\s+")

PATH, WORD, EXTRA, HIDDEN = 96, 32, 8, 24


def blocks(page: str | None) -> list[tuple[str, tuple[str, ...], float]]:
    """(text, path, share of characters in links) of each leaf block that has text, in page order.

    The path holds the open elements' names and the words of their class, id, role and itemprop. Character references
    are decoded once, white space is one space. Unclosed tags end where HTML lets them end or with the page.
    """
    page = page or ""
    out: list[tuple[str, tuple[str, ...], float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, anchors = [0], [0]
    #: names and words of the open elements that aren't inline, and how many each of the stack's brought
    names: list[str] = []
    at = 0

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            out.append((text, tuple(names[-PATH_WORDS:]), min(1.0, linked[0] / len(text))))
        parts.clear()
        linked[0] = 0

    def pop(k: int) -> None:
        if any(n not in INLINE for n, _ in stack[k:]):
            flush()
        brought = sum(1 + len(words) for n, words in stack[k:] if n not in INLINE)
        if brought:
            del names[-brought:]
        anchors[0] -= sum(n == "a" for n, _ in stack[k:])
        del stack[k:]

    def say(s: str) -> None:
        parts.append(s)
        if anchors[0]:
            linked[0] += len(s.strip())

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None:
                pop(k)
            elif name in ("br", "p"):
                flush()
            continue
        attrs = m[3] if m[2] else m[6]
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if name not in ("select", "textarea", "title") or end:
                at = end.end() if end else len(page)
            if name not in INLINE:
                flush()
            continue
        if name not in INLINE:
            while stack:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] not in INLINE), None)
                if k is None or name not in _CLOSES.get(stack[k][0], ()):
                    break
                pop(k)
            flush()
        if name in VOID or attrs.rstrip().endswith("/"):
            if name == "br":
                flush()
            continue
        words: tuple[str, ...] = ()
        if "=" in attrs:
            words = tuple(w for a in _ATTR.finditer(attrs) for w in _WORDS.findall((a[2] or a[3] or a[4] or "").lower())[:8])
        stack.append((name, words))
        anchors[0] += name == "a"
        if name not in INLINE:
            names += (name, *words)
    flush()
    return out


@functools.lru_cache(maxsize=1 << 12)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH, np.float32)
    for k, w in enumerate(path):
        h = zlib.crc32(w.encode())
        v[h % PATH] += 1.0 if h >> 16 & 1 else -1.0
    return v / max(1.0, float(np.sqrt(len(path))))


def features(page: list[tuple[str, tuple[str, ...], float]], first: int = 0, total: int | None = None) -> np.ndarray:
    """(blocks, PATH + WORD + EXTRA): hashed path, hashed words, counts; of total blocks those from first on."""
    x = np.zeros((len(page), PATH + WORD + EXTRA), np.float32)
    total = len(page) if total is None else total
    crc = zlib.crc32
    for k, (text, path, links) in enumerate(page):
        x[k, :PATH] = _path_vector(path)
        words = text.lower().encode().split(b" ")
        counts = np.bincount([crc(w) & (2 * WORD - 1) for w in words], minlength=2 * WORD)
        v = (counts[:WORD] - counts[WORD:]).astype(np.float32)
        x[k, PATH : PATH + WORD] = v / max(1.0, float(np.sqrt(v @ v)))
        n = len(words)
        x[k, PATH + WORD :] = (
            np.log1p(n) / 4, links, min(n, 8) / 8, text[-1] in ".!?", (first + k) / total, sum(map(text.count, ",.;")) / (n + 1), text[0].isupper(), min(len(path), 24) / 8,
        )
    return x


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLSTM:
    """Two LSTMs, one from each end, and a logistic output over both states at each block."""

    def __init__(self, inputs: int = PATH + WORD + EXTRA, hidden: int = HIDDEN, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p[f"W{d}"] = r.normal(0, 1 / np.sqrt(inputs + hidden), (inputs + hidden, 4 * hidden)).astype(np.float32)
            self.p[f"b{d}"] = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)].astype(np.float32)
        self.p["V"] = r.normal(0, 0.2, 2 * hidden).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, state: tuple[np.ndarray, np.ndarray] | None = None):
        """x (time, batch, inputs) -> states (time, batch, hidden), from the end if d is b. Padding holds the state.

        state: (h, c) to start from. What is returned beside the states: for step() what it needs, else the last (h, c).
        """
        t, n, m = x.shape
        h, c = state or (np.zeros((n, self.hidden), np.float32), np.zeros((n, self.hidden), np.float32))
        w, u = self.p[f"W{d}"][:m], self.p[f"W{d}"][m:]
        pre = x.reshape(-1, m) @ w + self.p[f"b{d}"]
        pre = pre.reshape(t, n, -1)
        states = np.zeros((t, n, self.hidden), np.float32)
        cache = []
        k = self.hidden
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = pre[s] + h @ u
            g = _sigmoid(z[:, : 3 * k])
            i, f, o = g[:, :k], g[:, k : 2 * k], g[:, 2 * k :]
            q = np.tanh(z[:, 3 * k :])
            c2 = f * c + i * q
            tc = np.tanh(c2)
            h2 = o * tc
            on = mask[s][:, None]
            if keep:
                cache.append((s, h, c, i, f, o, q, tc, on))
            h, c = np.where(on, h2, h), np.where(on, c2, c)
            states[s] = h
        return states, cache if keep else (h, c)

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, _ = self._run(x, mask, "f", False)
        b, _ = self._run(x, mask, "b", False)
        return f @ self.p["V"][: self.hidden] + b @ self.p["V"][self.hidden :] + self.p["c"]

    def long_logits(self, page: list[tuple[str, tuple[str, ...], float]], piece: int) -> np.ndarray:
        """logits() of one page, some blocks at a time: a state is carried over, so memory doesn't grow with the page."""
        out = np.zeros(len(page), np.float32)
        cuts = [(k, min(k + piece, len(page))) for k in range(0, len(page), piece)]
        for d, v, order in (("f", self.p["V"][: self.hidden], cuts), ("b", self.p["V"][self.hidden :], cuts[::-1])):
            state = None
            for s, e in order:
                states, state = self._run(features(page[s:e], s, len(page))[:, None, :], np.ones((e - s, 1), bool), d, False, state)
                out[s:e] += states[:, 0, :] @ v
        return out + self.p["c"]

    def step(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the blocks and its gradients, through time."""
        k = self.hidden
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        logit = runs["f"][0] @ self.p["V"][:k] + runs["b"][0] @ self.p["V"][k:] + self.p["c"]
        prob = _sigmoid(logit)
        n = max(1, int(mask.sum()))
        loss = -float((np.where(y > 0, np.log(prob + 1e-7), np.log(1 - prob + 1e-7)) * mask).sum()) / n
        err = ((prob - y) * mask / n).astype(np.float32)
        grads = {"c": np.array([err.sum()], np.float32), "V": np.r_[np.einsum("tn,tnk->k", err, runs["f"][0]), np.einsum("tn,tnk->k", err, runs["b"][0])]}
        m = x.shape[2]
        for d, v in (("f", self.p["V"][:k]), ("b", self.p["V"][k:])):
            u = self.p[f"W{d}"][m:]
            dw, db, du = np.zeros_like(self.p[f"W{d}"][:m]), np.zeros_like(self.p[f"b{d}"]), np.zeros_like(u)
            dh, dc = np.zeros((x.shape[1], k), np.float32), np.zeros((x.shape[1], k), np.float32)
            for s, h, c, i, f, o, q, tc, on in reversed(runs[d][1]):
                dh = dh + err[s][:, None] * v
                a = np.where(on, dh, 0)
                e = np.where(on, dc, 0) + a * o * (1 - tc * tc)
                dz = np.concatenate([e * q * i * (1 - i), e * c * f * (1 - f), a * tc * o * (1 - o), e * i * (1 - q * q)], axis=1)
                dw += x[s].T @ dz
                db += dz.sum(0)
                du += h.T @ dz
                dh, dc = np.where(on, dz @ u.T, dh), np.where(on, e * f, dc)
            grads[f"W{d}"], grads[f"b{d}"] = np.concatenate([dw, du]), db
        return loss, grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(p) for p in pages)
    x = np.zeros((t, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((t, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


def train(pages: int = 2000, epochs: int = 8, batch: int = 28, rate: float = 0.01, seed: int = 5) -> BiLSTM:
    """A labeller from generated pages, by Adam with clipped gradients. The same seed gives the same weights."""
    r = random.Random(seed)
    data = []
    for _ in range(pages):
        page, labels = generated_page(r)
        got = blocks(page)
        if len(got) == len(labels) and got:
            data.append((features(got), np.array(labels, np.float32)))
    net = BiLSTM(seed=seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        r.shuffle(data)
        ordered = [sorted(data[k : k + batch * 8], key=lambda d: len(d[1])) for k in range(0, len(data), batch * 8)]
        groups = [g[k : k + batch] for g in ordered for k in range(0, len(g), batch)]
        r.shuffle(groups)
        for g in groups:
            x, mask = padded([f for f, _ in g])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, labels) in enumerate(g):
                y[: len(labels), k] = labels
            _, grads = net.step(x, y, mask)
            norm = np.sqrt(sum(float((q * q).sum()) for q in grads.values()))
            step += 1
            for k, q in grads.items():
                q = q * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * q
                v2[k] = 0.999 * v2[k] + 0.001 * q * q
                net.p[k] -= (rate * (1 - epoch / (epochs + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def label(pages: list[list[tuple[str, tuple[str, ...], float]]], net: BiLSTM, cells: int = 1 << 15) -> list[np.ndarray]:
    """For each page which blocks are main text. Pages of like length are read together, cells bounds what is read at once."""
    out = [np.zeros(len(p), bool) for p in pages]
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    k = 0
    while k < len(order):
        if len(pages[order[k]]) > cells // 4:
            out[order[k]] = net.long_logits(pages[order[k]], cells // 4) > 0
            k += 1
            continue
        n = 1
        while k + n < len(order) and (n + 1) * len(pages[order[k + n]]) <= cells and n < 256:
            n += 1
        at = order[k : k + n]
        x, mask = padded([features(pages[j]) for j in at])
        z = net.logits(x, mask)
        for c, j in enumerate(at):
            out[j] = z[: len(pages[j]), c] > 0
        k += n
    return out


def extract(pages: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """(page_id, url, text, n_chars): the main blocks of each whole page in order, joined by one space.

    A null or empty html has an empty text; so has a page without a main block. n_chars counts code points. Repeated
    rows are judged alike. What stands in a canvas, audio, video or iframe element for browsers that cannot show it is no text. Other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]):
        net = BiLSTM()
        net.p = weights
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [blocks(h) for h in part.column(2).to_pylist()]
                texts = [" ".join(b[0] for b, on in zip(p, keep) if on) for p, keep in zip(found, label(found, net))]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as bigint) as page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
