"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai's common prefixes, binary search."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) of an integer array; with depth, suffixes that agree in depth symbols may stay unordered.

    Doubling as by Larsson and Sadakane: a suffix's rank is its group's, groups of one are done, and each
    round sorts only what is left of the open groups by the rank of the suffix h further on.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth = n if depth is None else depth
    if text.dtype == np.uint8:
        # the first eight bytes at once, highest first; past the end counts as zero, then shorter ones first
        key = np.zeros(n, np.uint64)
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        for j in range(8):
            key = (key << np.uint64(8)) | padded[j : j + n].astype(np.uint64)
        h = 8
    else:
        key, h = text, 1
    sa = np.argsort(key)
    ordered = key[sa]
    head = np.ones(n, bool)
    head[1:] = ordered[1:] != ordered[:-1]
    if h == 8 and n:
        # a suffix shorter than 8 sorts before those that it would tie with
        short = np.flatnonzero(sa > n - 8)
        if len(short):
            order = np.lexsort((np.minimum(n - sa, 8), np.cumsum(head)))
            sa = sa[order]
            ordered = key[sa]
            length = np.minimum(n - sa, 8)
            head[1:] = (ordered[1:] != ordered[:-1]) | (length[1:] != length[:-1])
    group = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    rank = np.empty(n, np.int64)
    rank[sa] = first[group]
    while h < depth:
        start = first[group]
        size = np.diff(np.append(first, n))[group]
        open_ = np.flatnonzero(size > 1)
        if not len(open_):
            break
        at = sa[open_]
        nxt = at + h
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        order = np.argsort(start[open_] * (n + 1) + second)
        sa[open_] = at[order]
        second = second[order]
        same_group = start[open_][1:] == start[open_][:-1]
        new_head = np.ones(len(open_), bool)
        new_head[1:] = ~same_group | (second[1:] != second[:-1])
        head[open_] = new_head
        group = np.cumsum(head) - 1
        first = np.flatnonzero(head)
        rank[sa] = first[group]
        h *= 2
    return sa, rank


def kasai(text: np.ndarray, sa: np.ndarray, rank_of: np.ndarray, limit: int, lanes: int = 4096, group: np.ndarray | None = None) -> np.ndarray:
    """lcp[i]: common prefix of the suffixes at sa[i-1] and sa[i], up to limit (lcp[0] = 0).

    Kasai's rule, that the prefix shrinks by one at most from a position to the next, is applied to many
    stretches of the text side by side: one numpy step serves the next position of every stretch. group is
    the rank that suffix_array() gives with a depth of limit or more: suffixes of one group agree that far and
    aren't ordered, so within a group the answer is limit, and behind one the comparison starts afresh.
    """
    n = len(text)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    width = max(1, -(-n // lanes))
    starts = np.arange(0, n, width)
    h = np.zeros(len(starts), np.int64)
    tied = np.zeros(len(starts), bool)
    word = 8
    padded = np.concatenate([text.astype(np.int64), np.full(word, -1, np.int64)]) if text.dtype != np.uint8 else None
    if padded is None:
        # eight bytes at a time, least significant first, so that trailing zero bits count equal bytes
        grown = np.concatenate([text, np.zeros(2 * word, np.uint8)])
        eight = np.zeros(n + word, np.uint64)
        for j in range(word):
            eight |= grown[j : j + n + word].astype(np.uint64) << np.uint64(8 * j)
    for step in range(width):
        at = starts + step
        live = np.flatnonzero(at < n)
        if not len(live):
            break
        i = at[live]
        j = before[i]
        got = np.where(j < 0, 0, np.maximum(h[live] - 1, 0))
        todo = j >= 0
        if group is not None:
            equal = todo & (group[i] == group[np.maximum(j, 0)])
            got[~equal & tied[live]] = 0
            got[equal] = limit
            tied[live] = equal
            todo &= ~equal
        todo = np.flatnonzero(todo)
        while len(todo):
            a, b, g = i[todo], j[todo], got[todo]
            room = np.minimum(n - np.maximum(a, b), limit) - g
            if padded is None:
                pa, pb = np.minimum(a + g, n), np.minimum(b + g, n)
                diff = eight[pa] ^ eight[pb]
                low = diff & (~diff + np.uint64(1))
                same = np.where(diff == 0, word, np.floor(np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64) // 8)
            else:
                same = (padded[np.minimum(a + g, n)] == padded[np.minimum(b + g, n)]).astype(np.int64)
            more = np.minimum(same, np.maximum(room, 0))
            got[todo] = g + more
            full = word if padded is None else 1
            todo = todo[(same == full) & (room > more)]
        h[live] = got
        lcp[rank_of[i]] = got
    return lcp


def ranks(sa: np.ndarray) -> np.ndarray:
    out = np.empty(len(sa), np.int64)
    out[sa] = np.arange(len(sa))
    return out


def search(text: np.ndarray, sa: np.ndarray, queries: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every query (a row of symbols, of which lengths count) the range [lo, hi) of suffixes that start with it.

    All queries are searched at once; one step of the binary search compares them symbol by symbol.
    """
    n, m = len(sa), len(queries)
    bounds = []
    for upper in (False, True):
        lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            mid = (lo[live] + hi[live]) // 2
            at = sa[mid]
            sign = np.zeros(len(live), np.int8)
            for d in range(queries.shape[1] if m else 0):
                open_ = np.flatnonzero((sign == 0) & (lengths[live] > d))
                if not len(open_):
                    break
                pos = at[open_] + d
                sym = np.where(pos < n, text[np.minimum(pos, n - 1)].astype(np.int64), -1)
                sign[open_] = np.sign(sym - queries[live[open_], d])
            right = (sign < 0) | (upper & (sign == 0))
            lo[live[right]] = mid[right] + 1
            hi[live[~right]] = mid[~right]
        bounds.append(lo)
    return bounds[0], bounds[1]


def common_prefix(text: np.ndarray, at: np.ndarray, queries: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many symbols each query has in common with the suffix at its position."""
    n, out = len(text), np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    for d in range(queries.shape[1] if len(at) else 0):
        pos = at[live] + d
        ok = (lengths[live] > d) & (pos < n)
        ok[ok] = text[pos[ok]] == queries[live[ok], d]
        live = live[ok]
        if not len(live):
            break
        out[live] += 1
    return out


def search_bytes(text: np.ndarray, sa: np.ndarray, other: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Whether the length bytes of other from each position begin a suffix in sa (all sorted that deep).

    Binary search for all positions at once, eight bytes a comparison.
    """

    def eights(a: np.ndarray) -> np.ndarray:
        grown, out = np.concatenate([a, np.zeros(8, np.uint8)]), np.zeros(len(a), np.uint64)
        for j in range(8):
            out = (out << np.uint64(8)) | grown[j : j + len(a)].astype(np.uint64)
        return out

    offsets = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    x, y = eights(text), eights(other)
    lo, hi, found = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64), np.zeros(len(at), bool)
    while True:
        live = np.flatnonzero((lo < hi) & ~found)
        if not len(live):
            return found
        mid = (lo[live] + hi[live]) // 2
        sign = np.zeros(len(live), np.int8)
        for d in offsets:
            open_ = np.flatnonzero(sign == 0)
            if not len(open_):
                break
            a, b = x[sa[mid[open_]] + d], y[at[live[open_]] + d]
            sign[open_] = (a > b).astype(np.int8) - (a < b).astype(np.int8)
        found[live[sign == 0]] = True
        lo[live[sign < 0]] = mid[sign < 0] + 1
        hi[live[sign > 0]] = mid[sign > 0]
