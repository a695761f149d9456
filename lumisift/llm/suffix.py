"""Suffix arrays of shards of text by induced sorting, and their common prefixes, in array operations."""

from __future__ import annotations

import numpy as np

from lumisift.llm.text import mix, powers

_BASE = 0xD6E8FEB86659FD93


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then the same for first[1], ..."""
    before = np.cumsum(count) - count
    return np.arange(count.sum()) + np.repeat(first - before, count)


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The text ends in a unique least symbol."""
    n = len(t)
    differs = np.flatnonzero(t[:-1] != t[1:])
    following = differs[np.minimum(np.searchsorted(differs, np.arange(n - 1)), len(differs) - 1)]
    return np.append(t[following] < t[following + 1], True)


class Inducer:
    """Induced sorting over one text of small symbols; the work of each pass is linear."""

    def __init__(self, t: np.ndarray):
        self.t = t.astype(np.int64)
        self.sym = t.astype(np.uint16)
        self.smaller = suffix_types(t)
        sizes = np.bincount(self.t)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.symbols = np.flatnonzero(sizes)
        self.left_most = np.flatnonzero(self.smaller[1:] & ~self.smaller[:-1]) + 1

    def _place(self, sa: np.ndarray, found: np.ndarray, at: np.ndarray, step: int) -> None:
        """Append suffixes to the fronts (step 1) or backs (step -1) of their buckets, in order."""
        if not len(found):
            return
        symbols = self.sym[found]
        order = np.argsort(symbols, kind="stable")
        counts = np.bincount(symbols, minlength=len(at))
        which = np.flatnonzero(counts)
        many = counts[which]
        if step > 0:
            slots = _ranges(at[which], many)
            at[which] += many
        else:
            before = np.cumsum(many) - many
            slots = np.repeat(at[which] - 1 + before, many) - np.arange(len(found))
            at[which] -= many
        sa[slots] = found[order]

    def induce(self, ordered: np.ndarray) -> np.ndarray:
        """Sort all suffixes from the leftmost-smaller ones, given in order."""
        n = len(self.t)
        sa = np.full(n, -1, np.int64)
        symbols = self.sym[ordered]
        by_symbol = ordered[np.argsort(symbols, kind="stable")]
        stops = np.cumsum(np.bincount(symbols, minlength=len(self.ends)))
        # Larger suffixes, from small symbols to large: each is found from its successor.
        front = self.begins.copy()
        for c in self.symbols:
            done = self.begins[c]
            while front[c] > done:
                batch = sa[done:front[c]]
                done = front[c]
                prior = batch[batch > 0] - 1
                self._place(sa, prior[~self.smaller[prior]], front, 1)
            marks = by_symbol[stops[c - 1] if c else 0:stops[c]]
            prior = marks[marks > 0] - 1
            self._place(sa, prior[~self.smaller[prior]], front, 1)
        # Smaller suffixes, from large symbols to small.
        back = self.ends.copy()
        for c in self.symbols[::-1]:
            done = self.ends[c]
            while back[c] < done:
                batch = sa[back[c]:done][::-1]
                done = back[c]
                prior = batch[batch > 0] - 1
                self._place(sa, prior[self.smaller[prior]], back, -1)
            batch = sa[self.begins[c]:front[c]][::-1]
            prior = batch[batch > 0] - 1
            self._place(sa, prior[self.smaller[prior]], back, -1)
        # The closing symbol has no successor to be found from.
        sa[0] = n - 1
        return sa


def _names(sums: np.ndarray, sorted_marks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1, 2, ... for the sorted substrings; equal substrings get equal names."""
    stop = ends[sorted_marks]
    code = mix((sums[stop] - sums[sorted_marks]) * powers(pow(_BASE, -1, 1 << 64), len(sums))[sorted_marks])
    length = stop - sorted_marks
    new = np.append(True, (code[1:] != code[:-1]) | (length[1:] != length[:-1]))
    return np.cumsum(new)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of `t`.

    `t` holds small numbers and ends in a 0 found nowhere else. Suffixes are classed as
    smaller or larger than their successor; a first induction sorts the substrings
    between leftmost-smaller positions, which are named by rank. The shorter text of
    names is sorted recursively: the rank of each run of names is made from the ranks
    of its halves, until all differ. From the leftmost-smaller
    suffixes in order a second induction sorts all others.
    """
    inducer = Inducer(t)
    marks = inducer.left_most
    n = len(t)
    if len(marks) < 2:
        return inducer.induce(marks)
    rough = inducer.induce(marks)
    is_mark = np.zeros(n, bool)
    is_mark[marks] = True
    sorted_marks = rough[is_mark[rough]]
    stop = np.zeros(n, np.int64)
    stop[marks] = np.append(marks[1:] + 1, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((mix(inducer.t.astype(np.uint64) + np.uint64(7))) * powers(_BASE, n)[:n], out=sums[1:])
    number = np.zeros(n, np.int64)
    number[marks] = np.arange(len(marks))
    rank = np.zeros(len(marks), np.int64)
    rank[number[sorted_marks]] = _names(sums, sorted_marks, stop)
    order = _order_names(rank)
    return inducer.induce(marks[order])


def _order_names(rank: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the text of names, by runs of 1, 2, 4, ... names."""
    m, run = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while True:
        sorted_rank = rank[order]
        tied = np.append(sorted_rank[1:] == sorted_rank[:-1], False)
        tied[1:] |= tied[:-1].copy()
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        items = order[at]
        key = np.append(rank, np.zeros(run, np.int64))[np.minimum(items + run, m)]
        key[items + run >= m] = 0
        again = np.lexsort((key, sorted_rank[at]))
        order[at] = items[again]
        # New ranks: the place of the first item of each group of equal (rank, key).
        head, key = sorted_rank[at], key[again]
        new = np.append(True, (head[1:] != head[:-1]) | (key[1:] != key[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        full = np.arange(1, m + 1)
        rank = np.empty(m, np.int64)
        full[at] = at[first] + 1
        rank[order] = full
        run *= 2


def common_prefixes(data: np.ndarray, sa: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: for each position, bytes shared with the suffix sorted before it.

    Only positions where the preceding bytes differ are compared; from there the length
    falls by one per position (Karkkainen, Manzini, Puglisi 2009). limit: no match runs
    past this position (the end of the piece a suffix is in).
    """
    n = len(sa)
    phi = np.empty(n, np.int64)
    phi[sa[0]] = -1
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    starts = (at == 0) | (phi <= 0)
    inner = ~starts
    starts[inner] = data[at[inner] - 1] != data[phi[inner] - 1]
    starts[1:] |= limit[1:] != limit[:-1]
    heads = np.flatnonzero(starts & (phi >= 0))
    padded = np.append(data, np.zeros(16, data.dtype)).astype(np.uint64)
    words = np.zeros(n + 8, np.uint64)
    for k in range(8):
        words |= (padded[k:k + n + 8] & np.uint64(0xFF)) << np.uint64(8 * k)
    length = np.zeros(len(heads), np.int64)
    active = np.arange(len(heads))
    most = limit[heads] - heads
    while len(active):
        a, b = heads[active] + length[active], phi[heads[active]] + length[active]
        inside = (np.maximum(a, b) < n) & (length[active] < most[active])
        active, a, b = active[inside], a[inside], b[inside]
        diff = words[a] ^ words[b]
        same = diff == 0
        rest = ~same
        low = diff[rest] & (~diff[rest] + np.uint64(1))
        length[active[rest]] += (np.log2(low.astype(np.float64)).astype(np.int64)) // 8
        length[active[same]] += 8
        active = active[same]
    out = np.zeros(n, np.int64)
    out[heads] = length + heads
    out[np.flatnonzero(starts & (phi < 0))] = np.flatnonzero(starts & (phi < 0))
    return np.maximum(np.maximum.accumulate(out) - at, 0)
