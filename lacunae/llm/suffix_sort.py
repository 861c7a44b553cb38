"""Suffix arrays by induced sorting, and common prefixes in text order, on numpy arrays.

Both scans of the induction go bucket by bucket: all entries of a bucket that stand already give
their predecessors at once, in order, to the buckets of their symbols; entries that land in the same
bucket are taken up in a next step. A scan so takes one step per symbol and per length of the
longest run of one symbol.
"""

from __future__ import annotations

import numpy as np

SMALL_BUCKETS = 4096


def smaller_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol is the only smallest."""
    step = np.empty(len(text), np.int8)
    np.sign(text[1:].astype(np.int64) - text[:-1], out=step[:-1], casting="unsafe")
    step[-1] = 1
    places = np.where(step != 0, np.arange(len(text)), len(text))
    following = np.minimum.accumulate(places[::-1])[::-1]
    return step[following] > 0


def induce(text: np.ndarray, small: np.ndarray, starts: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Order of all suffixes from the order of the leftmost-smaller ones (`seeds`)."""
    n, kinds = len(text), len(starts) - 1
    order = np.full(n, -1, np.int64)
    symbols = text[seeds]
    seed_at = np.searchsorted(symbols, np.arange(kinds + 1))
    head, tail = starts[:-1].copy(), starts[1:].copy()

    def give(entries: np.ndarray, smaller: bool, same: int) -> None:
        """Put the predecessors of `entries` that are of the wanted type into their buckets."""
        before = entries[entries > 0] - 1
        before = before[small[before] == smaller]
        if not len(before):
            return
        to = text[before]
        by = np.argsort(to, kind="stable")
        before, to = before[by], to[by]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        count = np.diff(np.concatenate([first, [len(to)]]))
        rank = np.arange(len(to)) - np.repeat(first, count)
        buckets = to[first]
        if smaller:
            order[tail[to] - 1 - rank] = before
            tail[buckets] -= count
        else:
            order[head[to] + rank] = before
            head[buckets] += count

    for c in range(kinds):  # larger suffixes, from the left
        done = starts[c]
        while done < head[c]:
            upto = head[c]
            give(order[done:upto], False, c)
            done = upto
        if seed_at[c] < seed_at[c + 1]:
            give(seeds[seed_at[c]:seed_at[c + 1]], False, c)
    for c in range(kinds - 1, -1, -1):  # smaller suffixes, from the right
        done = starts[c + 1]
        while tail[c] < done:
            upto = tail[c]
            give(order[upto:done][::-1], True, c)
            done = upto
        if starts[c] < head[c]:
            give(order[starts[c]:head[c]][::-1], True, c)
    order[0] = n - 1
    return order


def by_doubling(names: np.ndarray) -> np.ndarray:
    """Suffix order of a sequence over many symbols, by doubling the compared length."""
    n, rank, width = len(names), names.astype(np.int64), 1
    while True:
        following = np.zeros(n, np.int64)
        following[:max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 2) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1 or width >= n:
            return order
        width *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of symbols 0..k that ends with its only 0.

    Leftmost-smaller substrings are sorted by one induction and named; where names repeat, the
    sequence of names is sorted by the same method. A sequence of names has buckets of a few
    entries when its alphabet is large; from SMALL_BUCKETS symbols on it is sorted by doubling.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    starts = np.concatenate([[0], np.cumsum(np.bincount(text))]).astype(np.int64)
    small = smaller_types(text)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(leftmost) == 1:
        return induce(text, small, starts, leftmost)
    seeds = leftmost[np.argsort(text[leftmost], kind="stable")]
    order = induce(text, small, starts, seeds)
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    by_substring = order[is_leftmost[order]]

    # Name equal substrings alike: compare neighbours symbol by symbol up to the next leftmost one.
    end = np.empty(n, np.int64)
    end[leftmost] = np.concatenate([leftmost[1:], [n - 1]])
    a, b = by_substring[:-1], by_substring[1:]
    length = end[a] - a
    equal = length == end[b] - b
    live, at = np.flatnonzero(equal), 0
    while len(live):
        same = text[a[live] + at] == text[b[live] + at]
        equal[live[~same]] = False
        live = live[same]
        live = live[length[live] > at]
        at += 1
    equal &= b < n - 1
    names = np.empty(n, np.int64)
    names[by_substring] = np.concatenate([[0], np.cumsum(~equal)])
    reduced = names[leftmost]
    kinds = int(reduced.max()) + 1
    if kinds == len(leftmost):
        sorted_reduced = np.argsort(reduced)
    elif kinds <= SMALL_BUCKETS:
        sorted_reduced = suffix_array(reduced)
    else:
        sorted_reduced = by_doubling(reduced)
    return induce(text, small, starts, leftmost[sorted_reduced])


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each place of the text: bytes shared with the suffix before it in the order, up to `limit`.

    `data` are the bytes; the comparison goes eight bytes at a time over all places at once.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(limit + 16, np.uint8)])
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    live = np.flatnonzero(before >= 0)
    for at in range(0, limit, 8):
        left = np.ascontiguousarray(eight[live + at]).view("<u8").ravel()
        right = np.ascontiguousarray(eight[before[live] + at]).view("<u8").ravel()
        differ = left ^ right
        same = differ == 0
        out[live[same]] = at + 8
        rest = differ[~same]
        lowest = rest & (~rest + np.uint64(1))
        bits = np.log2(lowest.astype(np.float64)).astype(np.int64)
        out[live[~same]] = at + bits // 8
        live = live[same]
    room = n - np.maximum(np.arange(n), before)
    return np.minimum(np.minimum(out, limit), room)
