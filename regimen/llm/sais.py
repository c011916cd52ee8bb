"""Suffix arrays by induced sorting and permuted common prefixes, on NumPy vectors.

``suffix_array`` classifies suffixes as S (smaller than the next) or L, sorts
the leftmost-S (LMS) substrings by inducing, names them, solves the string of
names recursively when names repeat, and induces the rest from the sorted LMS
suffixes.  Inducing walks the buckets of first characters in order; what a
bucket already holds is handled as one vector, again while it induces into
itself.  Names of a recursive level are written as two digits, so alphabets,
and with them the number of buckets, stay small on every level; a short string
of names ends the recursion by sorting ranks of doubling lengths.
"""

from __future__ import annotations

import numpy as np


def s_types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their successor; the last (sentinel) is S."""
    n = len(s)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(s[1:].astype(np.int32) - s[:-1].astype(np.int32))
    rise[-1] = 1
    nearest = np.where(rise != 0, np.arange(n), n - 1)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    return rise[nearest] > 0


#: From so many items on, placing works on vectors.
FEW = 12
#: Strings of names up to this length are sorted by doubling ranks: deeper recursion would be mostly overhead.
SHORT = 100_000


def place(sa: np.ndarray, edge: np.ndarray, chars: np.ndarray, items: np.ndarray, step: int) -> None:
    """Append items, in order, to the buckets of their characters, upwards or downwards from ``edge``."""
    n = len(items)
    if n < FEW:
        for c, item in zip(chars.tolist(), items.tolist()):
            at = edge[c]
            sa[at] = item
            edge[c] = at + step
        return
    order = chars.argsort(kind="stable")
    c = chars[order]
    first = np.concatenate(([0], (c[1:] != c[:-1]).nonzero()[0] + 1))
    sizes = np.empty(len(first), np.int64)
    sizes[:-1], sizes[-1] = first[1:] - first[:-1], n - first[-1]
    bucket = c[first]
    heads = edge[bucket]
    at = np.arange(0, step * n, step)
    at += (heads - step * first).repeat(sizes)
    sa[at] = items[order]
    edge[bucket] = heads + step * sizes


def induce(s: np.ndarray, stype: np.ndarray, lms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All suffixes in order, from LMS suffixes in the order given (``ends``: end of each bucket)."""
    n, k = len(s), len(ends)
    sa = np.full(n, -1, np.int64)
    heads = np.concatenate([[0], ends[:-1]])
    tails = ends - 1
    place(sa, tails, s[lms[::-1]], lms[::-1], -1)
    lms_from = tails + 1
    fill = heads.copy()
    ltype = ~stype

    def sources(found: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        before = found[found > 0] - 1
        return before[wanted[before]]

    for c in range(k):  # L suffixes, smallest first
        done = heads[c]
        while done < fill[c]:
            part, done = sa[done:fill[c]], fill[c]
            new = sources(part, ltype)
            if len(new):
                place(sa, fill, s[new], new, 1)
        if lms_from[c] < ends[c]:
            new = sources(sa[lms_from[c]:ends[c]], ltype)
            if len(new):
                place(sa, fill, s[new], new, 1)
    tails = ends - 1
    for c in range(k - 1, -1, -1):  # S suffixes, largest first; they replace the LMS entries
        done = ends[c] - 1
        while done > tails[c]:
            part, done = sa[tails[c] + 1:done + 1][::-1], tails[c]
            new = sources(part, stype)
            if len(new):
                place(sa, tails, s[new], new, -1)
        if heads[c] < fill[c]:
            new = sources(sa[heads[c]:fill[c]][::-1], stype)
            if len(new):
                place(sa, tails, s[new], new, -1)
    sa[0] = n - 1  # the sentinel alone precedes everything
    return sa


def lms_names(s: np.ndarray, order: np.ndarray, next_lms: np.ndarray) -> np.ndarray:
    """Names, by order, of LMS positions whose substrings (to the next LMS position, inclusive) are sorted."""
    a, b = order[:-1], order[1:]
    length = next_lms[a] - a
    same = length == next_lms[b] - b
    at, d = np.flatnonzero(same), 0
    while len(at):
        equal = s[a[at] + d] == s[b[at] + d]
        same[at[~equal]] = False
        at = at[equal]
        at = at[length[at] > d]
        d += 1
    return np.concatenate([[0], np.cumsum(~same)])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of ``s``, whose last element is its only smallest, 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    s = s.astype(np.int16)
    k = int(s.max()) + 1
    ends = np.cumsum(np.bincount(s, minlength=k))
    stype = s_types(s)
    lms = np.flatnonzero(stype[1:] & ~stype[:-1]) + 1
    sa = induce(s, stype, lms, ends)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    next_lms = np.zeros(n, np.int64)
    next_lms[lms] = np.append(lms[1:], n - 1)
    names = lms_names(s, order, next_lms)
    if names[-1] + 1 < len(lms):
        by_text = np.zeros(n, np.int64)
        by_text[order] = names
        order = lms[reduced_order(by_text[lms], n)]
    return induce(s, stype, order, ends)


def reduced_order(names: np.ndarray, n: int) -> np.ndarray:
    """Order of the suffixes of a string of names; its last name is its only smallest."""
    base = int(np.sqrt(names.max() + 1)) + 1
    if len(names) <= SHORT or 2 * len(names) > 0.95 * n or base > 30_000:
        return by_doubling(names)  # short, or two digits a name would not make it shorter
    digits = np.empty(2 * len(names) + 1, np.int64)
    digits[0:-1:2], digits[1:-1:2] = names // base + 1, names % base + 1
    digits[-1] = 0
    sa = suffix_array(digits)
    sa = sa[1:]
    return sa[sa % 2 == 0] // 2


def by_doubling(names: np.ndarray) -> np.ndarray:
    """Suffix order by ranks of doubling lengths."""
    rank, step, n = names.astype(np.int64), 1, len(names)
    while True:
        key = rank * (n + 1)
        key[:max(0, n - step)] += rank[step:] + 1
        order = np.argsort(key)
        new = np.zeros(n, np.int64)
        np.cumsum(key[order[1:]] != key[order[:-1]], out=new[1:])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """PLCP: by text position, the common prefix (at most ``most``) with the preceding suffix in the array.

    Only irreducible positions, whose preceding characters differ, are compared;
    every other position's value is its left neighbour's less one.  Irreducible
    prefixes add up to at most 2 n log n, so they are compared in full."""
    n = len(sa)
    before = np.zeros(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    at = np.arange(n)
    irreducible = (before <= 0) | (at == 0)
    rest = np.flatnonzero(~irreducible)
    irreducible[rest] = text[rest - 1] != text[before[rest] - 1]
    at = np.flatnonzero(irreducible & (before >= 0))
    value = np.zeros(n, np.int64)
    padded = np.concatenate([text.astype(np.uint16), np.zeros(4, np.uint16)])
    words = np.zeros(n + 1, np.uint64)  # four characters at a time
    for i in range(4):
        words[:n] |= padded[i:i + n].astype(np.uint64) << np.uint64(16 * i)
    length = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):
        p, q = at[live] + length[live], before[at[live]] + length[live]
        inside = (p < n) & (q < n)
        diff = np.where(inside, words[np.minimum(p, n)] ^ words[np.minimum(q, n)], np.uint64(1))
        low = diff & (~diff + np.uint64(1))
        same = np.where(diff == 0, 4, (np.bitwise_count(low - np.uint64(1)) // 16).astype(np.int64))
        length[live] += same
        live = live[same == 4]
    value[at] = length
    reach = np.full(n, -1, np.int64)
    reach[at] = length + at
    first = np.flatnonzero(before < 0)
    reach[first] = first
    # a reducible position continues the last irreducible one: value + position is constant
    last = np.maximum.accumulate(np.where(irreducible, np.arange(n), 0))
    value = np.maximum(reach[last] - np.arange(n), 0)
    return np.minimum(value, most)
