"""Suffix arrays by induced sorting, and bounded permuted common prefixes.

Induction goes through the buckets letter by letter in whole-array steps. Where letters occur too seldom for that, as in the
names of a recursion, the runs of larger (then of smaller) suffixes are short, and radix passes over them induce all at once;
with a long run it goes suffix by suffix. All three give the same order in linear time.
"""

from __future__ import annotations

import numpy as np

from ._common import mix

#: Occurrences a letter from which whole-array steps pay, and the mean rest of a run up to which radix passes do.
OFTEN, RUN = 200, 8


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the empty suffix after the last counts as smallest."""
    n = len(s)
    sign = np.empty(n, np.int8)
    sign[:-1] = (s[1:] > s[:-1]).view(np.int8) - (s[1:] < s[:-1]).view(np.int8)
    sign[-1] = -1
    at = np.where(sign != 0, np.arange(n, dtype=np.int32), np.int32(n))
    return sign[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, letters: int) -> np.ndarray:
    """All suffixes in order, induced from `seeds`, leftmost-smaller suffixes already in order. A bucket is worked off in
    runs: what a run puts into its own bucket is the next run."""
    n = len(s)
    ends = np.cumsum(np.bincount(s, minlength=letters))
    starts = ends - np.bincount(s, minlength=letters)
    sa = np.full(n, -1, np.int32)
    order = np.argsort(s[seeds], kind="stable")
    seeds = seeds[order]
    own = s[seeds]
    first = np.searchsorted(own, np.arange(letters + 1))

    def deal(at: np.ndarray, heads: np.ndarray, step: int) -> None:
        """Puts suffixes into their buckets, in this order."""
        c = s[at]
        by = np.argsort(c, kind="stable")
        at, c = at[by], c[by]
        cut = np.flatnonzero(np.diff(c, prepend=-1))
        size = np.diff(np.append(cut, len(c)))
        place = np.arange(len(c), dtype=np.int32) - np.repeat(cut, size)
        sa[heads[c] + step * place] = at
        heads[c[cut]] += step * size

    heads = starts.copy()
    if not small[n - 1]:
        deal(np.array([n - 1], np.int32), heads, 1)
    for c in range(letters):  # larger suffixes, from the left
        done = starts[c]
        while done < heads[c]:
            run = sa[done : heads[c]] - 1
            done = heads[c]
            run = run[run >= 0]
            run = run[~small[run]]
            if len(run):
                deal(run, heads, 1)
        run = seeds[first[c] : first[c + 1]] - 1
        run = run[run >= 0]
        run = run[~small[run]]
        if len(run):
            deal(run, heads, 1)
    tails = ends - 1
    for c in range(letters - 1, -1, -1):  # smaller ones, from the right
        done = ends[c] - 1
        while done > tails[c]:
            run = sa[tails[c] + 1 : done + 1][::-1] - 1
            done = tails[c]
            run = run[run >= 0]
            run = run[small[run]]
            if len(run):
                deal(run, tails, -1)
        run = sa[starts[c] : heads[c]][::-1] - 1
        run = run[run >= 0]
        run = run[small[run]]
        if len(run):
            deal(run, tails, -1)
    return sa


def _induce_each(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, letters: int) -> np.ndarray:
    """As _induce, one suffix after another."""
    n = len(s)
    ends = np.cumsum(np.bincount(s, minlength=letters))
    heads, tails = (ends - np.bincount(s, minlength=letters)).tolist(), ends.tolist()
    # the letter before each suffix if the suffix there is a larger (smaller) one, else -1; a free place, -1, has none either
    larger, smaller = (np.append(np.append(-1, np.where(small[:-1] == kind, s[:-1], -1)), -1).tolist() for kind in (False, True))
    sa = [-1] * n
    for c, i in zip(s[seeds[::-1]].tolist(), seeds[::-1].tolist()):
        tails[c] = at = tails[c] - 1
        sa[at] = i
    if not small[n - 1]:
        sa[heads[int(s[n - 1])]] = n - 1
        heads[int(s[n - 1])] += 1
    for p in sa:  # places ahead of it fill up as it goes
        c = larger[p]
        if c >= 0:
            at = heads[c]
            sa[at] = p - 1
            heads[c] = at + 1
    tails = ends.tolist()
    for p in reversed(sa):
        c = smaller[p]
        if c >= 0:
            tails[c] = at = tails[c] - 1
            sa[at] = p - 1
    return np.array(sa, np.int32)


def _radix(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """order, stably sorted by key (one value from 0 to 2**32 - 1 for each of its places)."""
    by = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    if key.max(initial=0) > 0xFFFF:
        by = by[np.argsort((key[by] >> 16).astype(np.uint16), kind="stable")]
    return order[by]


def _induce_runs(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, letters: int) -> np.ndarray:
    """As _induce: a larger suffix is told by the letters of its run of larger ones and the seed that ends the run, a smaller
    one by those of its run and the larger suffix there. Long runs: suffix by suffix."""
    n = len(s)
    change = np.append(np.flatnonzero(small[1:] != small[:-1]) + 1, n)
    stop = np.repeat(change, np.diff(change, prepend=0)).astype(np.int64)
    longest = int(np.diff(change, prepend=0).max())
    if (stop - np.arange(n)).sum() > RUN * n:
        return _induce_each(s, small, seeds, letters)
    symbol = np.append(2 * s.astype(np.int64) + small + 1, 0)  # of one letter, larger suffixes come before smaller ones
    rank = np.zeros(n + 1, np.int64)
    rank[seeds] = np.arange(1, len(seeds) + 1)
    parts = []
    for kind in (False, True):
        every = np.flatnonzero(small == kind)
        every = _radix(every, rank[stop[every]])
        length = stop[every] - every
        every, length = _radix(every, length), np.sort(length)
        edge = np.searchsorted(length, np.arange(longest + 2))
        at = every[:0]
        for t in range(longest, 0, -1):  # those with a run of t, which come before longer ones so far, join in
            at = np.concatenate([every[edge[t] : edge[t + 1]], at])
            at = _radix(at, symbol[at + t])
        at = _radix(at, symbol[at])
        rank[at] = np.arange(1, len(at) + 1)
        parts.append(at)
    every = np.concatenate(parts)
    return _radix(every, symbol[every]).astype(np.int32)


def suffix_array(s: np.ndarray, letters: int) -> np.ndarray:
    """Starts of the suffixes of s (integers from 0 to letters - 1) in order; a suffix that is another's prefix comes first."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    used = np.unique(s)
    if len(used) < letters:  # letters that occur
        rank = np.zeros(int(used[-1]) + 1, np.int64)
        rank[used] = np.arange(len(used))
        s, letters = rank[s], len(used)
    s = s.astype(np.int16 if letters < 1 << 15 else np.int64)  # 16-bit letters are dealt by a radix sort
    induce = _induce if n >= OFTEN * letters else _induce_runs
    small = _types(s)
    left = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if not len(left):
        return induce(s, small, left, letters)
    sorted_left = induce(s, small, left, letters)
    is_left = np.zeros(n, bool)
    is_left[left] = True
    sorted_left = sorted_left[is_left[sorted_left]]
    # names: a substring runs to the next leftmost-smaller suffix; equal ones have equal hashes and lengths
    base = 0x9E3779B97F4A7C15
    power = np.empty(n + 1, np.uint64)
    power[0] = 1
    power[1:] = np.uint64(base)
    power = np.cumprod(power)
    inverse = np.empty(n + 1, np.uint64)
    inverse[0] = 1
    inverse[1:] = np.uint64(pow(base, -1, 1 << 64))
    inverse = np.cumprod(inverse)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((mix(s.astype(np.uint64) + np.uint64(77)) + small.astype(np.uint64)) * power[:n], out=total[1:])
    stop = np.append(left[1:] + 1, n)
    value = np.zeros(n, np.uint64)
    value[left] = (total[stop] - total[left]) * inverse[left] + (stop - left).astype(np.uint64)
    v = value[sorted_left]
    name = np.zeros(n, np.int64)
    name[sorted_left] = np.cumsum(np.diff(v, prepend=v[0]) != 0)
    reduced = name[left]
    names = int(reduced.max()) + 1
    order = left[np.argsort(reduced)] if names == len(left) else left[suffix_array(reduced, names)]
    return induce(s, small, order, letters)


def common_prefix_at_least(data: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """For each rank after the first, whether the suffix shares `length` bytes with the one before it. Permuted: compared in
    text order, eight bytes at a time, and further only where all was equal so far."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)]).astype(np.uint64)
    word = padded[: n + length].copy()
    for k in range(1, 8):
        word |= padded[k : k + n + length] << np.uint64(8 * k)
    at = np.flatnonzero((before >= 0) & (np.arange(n) + length <= n) & (before + length <= n))
    for k in [*range(0, length - 7, 8), length - 8]:
        at = at[word[at + k] == word[before[at] + k]]
    out = np.zeros(n, bool)
    out[at] = True
    return out[sa]
