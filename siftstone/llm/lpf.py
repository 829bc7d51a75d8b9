"""Longest-previous-factor arrays in numpy: suffix order, neighbours' common prefixes, previous and next smaller."""

from __future__ import annotations

import numpy as np


def suffix_ranks(text: np.ndarray, limit: int) -> np.ndarray:
    """Ranks of the suffixes by their first limit bytes; equal where those are equal. Past the end stand zeros.

    text: uint8. Ranks start from words of eight bytes where limit allows, and double the length that they tell apart.
    """
    n = len(text)
    if limit >= 8:
        rank, step = np.unique(words(text).byteswap(), return_inverse=True)[1].astype(np.int64), 8
    else:
        rank, step = text.astype(np.int64) + 1, 1
    while step < limit:
        take = min(step, limit - step)
        low = np.zeros(n, np.int64)
        low[: max(0, n - take)] = rank[take:]
        rank = np.unique(rank * (int(low.max()) + 1) + low, return_inverse=True)[1].astype(np.int64)
        step += take
    return rank


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, the first one lowest."""
    padded = np.r_[text, np.zeros(8, np.uint8)]
    return np.ndarray((len(text),), "<u8", padded.data, strides=(1,)).astype(np.uint64)


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Bytes that the suffixes from a and from b have in common, up to limit, by comparing them eight at a time."""
    w, n = words(text), len(text)
    out = np.zeros(len(a), np.int64)
    most = np.minimum(limit, n - np.maximum(a, b))
    active = np.arange(len(a))
    while len(active):
        k = out[active]
        x = w[a[active] + k] ^ w[b[active] + k]
        # the bits below the lowest that differs
        equal = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8
        out[active] = np.minimum(k + equal, most[active])
        active = active[(equal == 8) & (out[active] < most[active])]
    return out


def nearest_smaller(owner: np.ndarray, common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order the previous place with a smaller owner, and the common prefix with it.

    common[i]: common prefix of places i-1 and i. A place is -1 when it is none, or shares fewer than least bytes.
    All places jump at once: what lies between a place and its pointer never has a smaller owner, so a pointer may
    take its target's pointer, and distances double.
    """
    n = len(owner)
    at = np.arange(-1, n - 1)
    share = common.astype(np.int64).copy()
    if n:
        share[0] = 0
    active = np.arange(n)
    while len(active):
        to = at[active]
        lost = (to < 0) | (share[active] < least)
        at[active[lost]] = -1
        active, to = active[~lost], to[~lost]
        wrong = owner[to] >= owner[active]
        active, to = active[wrong], to[wrong]
        # read all before any is written
        share_to, at_to = share[to], at[to]
        share[active] = np.minimum(share[active], np.where(at_to < 0, 0, share_to))
        at[active] = at_to
    return at, np.where(at < 0, 0, share)


def longest_previous_factor(text: np.ndarray, owner: np.ndarray, limit: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each position the length of the longest match, up to limit, from a position of a smaller owner, and that one.

    Matches of fewer than least bytes count as none: length 0, position -1. owner: a number for each position. In
    suffix order the longest match is with the nearest smaller owner before or after; what two suffixes have in common
    is the least that any neighbours between them have.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # of suffixes that the zeros past the end make equal, the shorter stand first, between none that go on
    key = suffix_ranks(text, limit) * (limit + 1) + limit
    short = np.arange(max(0, n - limit), n)
    key[short] += n - short - limit
    order = np.argsort(key, kind="stable")
    common = np.zeros(n, np.int64)
    common[1:] = common_prefixes(text, order[:-1], order[1:], limit)
    who = owner[order]
    at, before = nearest_smaller(who, common, least)
    back = np.r_[0, common[1:][::-1]]
    after_at, after = nearest_smaller(who[::-1], back, least)
    after_at, after = n - 1 - after_at[::-1], after[::-1]
    later = after > before
    length, source = np.empty(n, np.int64), np.full(n, -1)
    length[order] = np.where(later, after, before)
    place = np.where(later, after_at, at)
    found = length[order] > 0
    source[order[found]] = order[place[found]]
    return length, source
