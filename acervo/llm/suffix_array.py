"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller or larger than their successor. The leftmost-smaller (LMS) substrings are
sorted by one induction and named; if names repeat, the string of names is sorted recursively; a second
induction turns the order of the LMS suffixes into the whole array. Over a small alphabet an induction goes
bucket by bucket with array operations; over the many names of a deeper level it goes suffix by suffix.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced bucket by bucket.
SMALL = 1024


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes in ascending order; text holds non-negative integers."""
    text = np.asarray(text, np.int64)
    if len(text) < 2:
        return np.arange(len(text))
    symbols, dense = np.unique(text, return_inverse=True)
    with_end = np.concatenate([dense + 1, [0]])  # an end that is less than everything
    return _sort(with_end, len(symbols) + 1)[1:]


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the end is, by convention."""
    n = len(s)
    step = np.sign(s[1:] - s[:-1])
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal symbols ends
    small = np.ones(n, bool)
    small[:-1] = np.concatenate([step, [1]])[following] > 0
    return small


def _sort(s: np.ndarray, k: int) -> np.ndarray:
    n = len(s)
    small = classify(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _induce_by_bucket if k <= SMALL else _induce_by_suffix
    order = induce(s, k, small, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sorted_lms = order[is_lms[order]]
    names, count = _named(s, small, lms, sorted_lms)
    if count < len(lms):
        ranks = _sort(names, count)
        sorted_lms = lms[ranks]
    return induce(s, k, small, sorted_lms)


def _named(s: np.ndarray, small: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """The name of each LMS substring, in text order: equal substrings of neighbours in the order have one name."""
    n = len(s)
    length = np.empty(n, np.int64)
    length[lms] = np.diff(lms, append=n - 1) + 1  # both LMS symbols included; the end's is 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    step = 0
    while len(live):
        x, y = a[live] + step, b[live] + step
        equal = (s[x] == s[y]) & (small[x] == small[y])
        same[live[~equal]] = False
        live = live[equal]
        step += 1
        live = live[step < length[a[live]]]
    rank = np.zeros(len(ordered), np.int64)
    rank[1:] = np.cumsum(~same)
    name = np.empty(n, np.int64)
    name[ordered] = rank
    return name[lms], int(rank[-1]) + 1


def _induce_by_bucket(s: np.ndarray, k: int, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n = len(s)
    size = np.bincount(s, minlength=k)
    end = np.cumsum(size)
    start = end - size
    larger = np.bincount(s[~small], minlength=k)
    order = np.full(n, -1, np.int64)
    key = s.astype(np.uint16)
    # seeds: LMS suffixes at the ends of their buckets, in the given order
    seed_of = key[lms]
    by = np.argsort(seed_of, kind="stable")
    seeds = lms[by]
    seed_count = np.bincount(seed_of, minlength=k)
    seed_end = np.cumsum(seed_count)

    def put(found: np.ndarray, fill: np.ndarray, sign: int) -> None:
        """Appends found to its buckets in order, upwards or downwards."""
        symbols = key[found]
        by = np.argsort(symbols, kind="stable")
        symbols, found = symbols[by], found[by]
        cut = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        width = np.diff(cut, append=len(symbols))
        heads = symbols[cut]
        at = np.arange(len(symbols)) - np.repeat(cut, width)
        order[np.repeat(fill[heads], width) + sign * at] = found
        fill[heads] += sign * width

    # larger suffixes, upwards
    fill = start.copy()
    for c in range(k):
        done = start[c]
        while done < fill[c]:
            stop = fill[c]
            before = order[done:stop] - 1
            done = stop
            before = before[before >= 0]
            before = before[~small[before]]
            if len(before):
                put(before, fill, 1)
        own = seeds[seed_end[c] - seed_count[c] : seed_end[c]] - 1
        own = own[own >= 0]
        if len(own):  # before an LMS suffix there is always a larger one
            put(own, fill, 1)
    # smaller suffixes, downwards; the seeds are found again
    fill = end - 1
    for c in range(k - 1, -1, -1):
        done = end[c] - 1
        while done > fill[c]:
            stop = fill[c]
            before = order[stop + 1 : done + 1][::-1] - 1
            done = stop
            before = before[before >= 0]
            before = before[small[before]]
            if len(before):
                put(before, fill, -1)
        before = order[start[c] : start[c] + larger[c]][::-1] - 1
        before = before[before >= 0]
        before = before[small[before]]
        if len(before):
            put(before, fill, -1)
    order[0] = n - 1  # the end
    return order


def _induce_by_suffix(s: np.ndarray, k: int, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n = len(s)
    ends = np.cumsum(np.bincount(s, minlength=k))
    symbols, is_small = s.tolist(), small.tolist()
    order = [-1] * n
    fill = (ends - 1).tolist()
    for i in reversed(lms.tolist()):
        c = symbols[i]
        order[fill[c]] = i
        fill[c] -= 1
    fill = [0, *ends[:-1].tolist()]
    for at in range(n):
        i = order[at] - 1
        if i >= 0 and not is_small[i]:
            c = symbols[i]
            order[fill[c]] = i
            fill[c] += 1
    fill = (ends - 1).tolist()
    for at in range(n - 1, -1, -1):
        i = order[at] - 1
        if i >= 0 and is_small[i]:
            c = symbols[i]
            order[fill[c]] = i
            fill[c] -= 1
    order[0] = n - 1
    return np.array(order, np.int64)


def permuted_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place, how far its suffix agrees with the one before it in the order (0 for the first).

    Where a place and its neighbour have equal symbols before them, the value is one less than the place
    before has; all others are compared symbol by symbol, side by side.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    neighbour = np.full(n, -1, np.int64)
    neighbour[order[1:]] = order[:-1]
    derived = np.zeros(n, bool)
    derived[1:] = (neighbour[1:] > 0) & (neighbour[:-1] >= 0) & (neighbour[1:] == neighbour[:-1] + 1)
    derived[1:] &= text[:-1] == text[np.maximum(neighbour[1:] - 1, 0)]
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(~derived & (neighbour >= 0))
    step = 0
    other = neighbour[live]
    while len(live):
        inside = (live + step < n) & (other + step < n)
        live, other = live[inside], other[inside]
        equal = text[live + step] == text[other + step]
        live, other = live[equal], other[equal]
        out[live] += 1
        step += 1
    # along a run of derived places the value falls by one a place, and never under zero
    places = np.arange(n)
    head = np.maximum.accumulate(np.where(derived, 0, places))
    return np.where(derived, np.maximum(out[head] - (places - head), 0), out)
