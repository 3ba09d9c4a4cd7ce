"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

The scans of induced sorting are done in steps of whole bucket ranges: a step
takes the buckets up to the first one that its own suffixes lead to, which no
later suffix of the step can change, and places all their predecessors at once.
"""

from __future__ import annotations

import numpy as np

#: Values of the longest substring that is sorted by its words.
LONG = 1 << 11


def _scan(sa: np.ndarray, leads: np.ndarray, begin: np.ndarray, stop: np.ndarray, front: np.ndarray) -> None:
    """Induce suffixes from those in ``sa``, by ascending rank.

    ``leads``: the bucket of each suffix's predecessor, or -1 where that is not
    to be placed; its last entry, -1, is for the unused places of ``sa``, which
    hold -1. Bucket c is sa[begin[c]:stop[c]]; new suffixes go from front[c] on.
    The descending scan is this one over reversed arrays.
    """
    buckets, at, width = len(begin), 0, 64
    starts, stops = begin.tolist(), stop.tolist()
    narrow = np.uint16 if buckets <= 1 << 16 else np.int32  # short keys are sorted by their digits
    while at < buckets:
        # Suffixes of the bucket itself come first: each wave is the predecessors of the one before.
        end = int(front[at])
        wave = sa[starts[at] : end]
        while len(wave):
            wave = wave[leads[wave] == at] - 1
            sa[end : end + len(wave)] = wave
            end += len(wave)
        front[at] = end
        to = min(buckets, at + width)
        own = sa[starts[at] : stops[to - 1]]
        target = leads[own]
        if to > at + 1:
            inside = target[(target > at) & (target < to)]
            if len(inside):
                # Buckets from the first one reached on are not complete yet.
                to = max(at + 1, int(inside.min()))
                own = own[: stops[to - 1] - starts[at]]
                target = target[: len(own)]
        kept = np.flatnonzero(target > at)
        if len(kept):
            target = target[kept]
            by = np.argsort(target.astype(narrow), kind="stable")
            target = target[by]
            first = np.empty(len(target), bool)
            first[0] = True
            np.not_equal(target[1:], target[:-1], out=first[1:])
            first = np.flatnonzero(first)
            size = np.empty(len(first), np.int64)
            size[:-1] = first[1:] - first[:-1]
            size[-1] = len(target) - first[-1]
            reached = target[first]
            sa[np.repeat(front[reached] - first, size) + np.arange(len(target))] = own[kept[by]] - 1
            front[reached] += size
        width = max(1, min(1 << 16, 2 * (to - at)))
        at = to


def _leads(s: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    out = np.full(len(s) + 1, -1, np.int32)
    out[1:-1] = s[:-1]
    out[1:-1][~chosen[:-1]] = -1
    return out


def _induced(s: np.ndarray, k: int, small: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """The order of all suffixes that the order of the leftmost smaller ones, ``stars``, induces."""
    n = len(s)
    size = np.bincount(s, minlength=k)
    stop = np.cumsum(size)
    begin = stop - size
    sa = np.full(n, -1, np.int32)
    # The leftmost smaller suffixes at their buckets' ends, in order.
    chars = s[stars]
    by = np.argsort(chars, kind="stable")
    count = np.bincount(chars, minlength=k)
    first = np.cumsum(count) - count
    sa[(stop - count)[chars[by]] + np.arange(len(by)) - first[chars[by]]] = stars[by]
    _scan(sa, _leads(s, ~small), begin, stop, begin.copy())
    # The larger ones are in place; the smaller ones are placed anew, from the largest down.
    sa[np.append(small, False)[sa]] = -1
    sa[0] = n - 1  # the end mark is the one smaller suffix that nothing precedes
    front = (n - stop)[::-1].copy()
    front[k - 1] += 1
    down = _leads((k - 1 - s).astype(np.int32), small)
    _scan(sa[::-1], down, (n - stop)[::-1], (n - begin)[::-1], front)
    return sa


def _same_strings(s: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether paired substrings are equal."""
    same = size_a == size_b
    open_ = np.flatnonzero(same)
    k = 0
    while len(open_):
        equal = s[a[open_] + k] == s[b[open_] + k]
        same[open_[~equal]] = False
        k += 1
        open_ = open_[equal]
        open_ = open_[size_a[open_] > k]
    return same


def _words(values: np.ndarray) -> tuple[np.ndarray, int]:
    """At every position the eight bytes from it on, as one number in reading order, and how many values they are."""
    top = int(values.max())
    values = values.astype(">u1" if top < 1 << 8 else ">u2" if top < 1 << 16 else ">u4")
    wide = values.itemsize
    return np.ndarray((len(values),), ">u8", values.tobytes() + bytes(8), strides=(wide,)), 8 // wide


def _sorted_stars(s: np.ndarray, k: int, stars: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The leftmost smaller suffixes by the substrings they begin, and where these differ; None if one is too long for it.

    A substring ends with the next leftmost smaller suffix's character, which
    counts as more than the same character elsewhere. So none is the beginning
    of another, and words of eight bytes decide, zero where a substring is over.
    """
    used = np.cumsum(np.bincount(s, minlength=k) > 0) - 1
    words, each = _words((2 * used)[s])
    size = np.diff(np.append(stars, len(s) - 1)) + 1
    if int(size.max()) > LONG:
        return None
    bits = 64 // each

    def word(at: np.ndarray, done: int) -> np.ndarray:
        left = size[at] - done
        over = (np.maximum(each - left, 0) * bits).astype(np.uint64)
        own = words[stars[at] + done].astype(np.uint64)
        return ((own >> over) << over) | ((left <= each).astype(np.uint64) << over)

    own = word(np.arange(len(stars)), 0)
    order = np.argsort(own)
    own = own[order]
    new = np.append(True, own[1:] != own[:-1])
    open_, done = np.arange(len(stars)), each
    while True:
        # A group that is equal so far goes on as a whole or not at all, and keeps its places.
        first = new[open_]
        open_ = open_[~(first & np.append(first[1:], True)) & (size[order[open_]] > done)]
        if not len(open_):
            return stars[order], new[1:]
        group, own = np.cumsum(new[open_]), word(order[open_], done)
        by = np.lexsort((own, group))
        order[open_] = order[open_][by]
        own = own[by]
        new[open_[1:]] |= own[1:] != own[:-1]
        done += each


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """The suffix array of ``s`` (values 0..k-1; its last value is 0 and occurs nowhere else).

    Suffixes are classified as smaller or larger than their successor; leftmost
    smaller ones delimit substrings, which are sorted (by their words, or by
    induction where they are long) and named; if names repeat, the string of
    names is sorted recursively; one more induction from the sorted leftmost
    smaller suffixes places all others.
    """
    s = np.asarray(s, np.uint8 if k <= 1 << 8 else np.uint16 if k <= 1 << 16 else np.int32)
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int32)
    # A suffix compares with its successor as its character does with the next different one.
    change = np.flatnonzero(s[1:] != s[:-1])
    up = np.concatenate([s[change] < s[change + 1], [True]])
    small = np.repeat(up, np.diff(np.concatenate([[0], change + 1, [n]])))
    small[n - 1] = True
    stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(stars) == 1:
        return _induced(s, k, small, stars)
    found = _sorted_stars(s, k, stars)
    if found is None:
        rough = _induced(s, k, small, stars)
        is_star = np.zeros(n, bool)
        is_star[stars] = True
        ordered = rough[is_star[rough]]
        size = np.zeros(n, np.int32)
        size[stars] = np.diff(np.concatenate([stars, [n - 1]])) + 1
        new = ~_same_strings(s, ordered[:-1], ordered[1:], size[ordered[:-1]], size[ordered[1:]])
    else:
        ordered, new = found
    name = np.zeros(n, np.int32)
    name[ordered] = np.concatenate([[0], np.cumsum(new)])
    names = name[stars]
    different = int(names.max()) + 1
    order = np.argsort(names, kind="stable") if different == len(stars) else suffix_array(names, different)
    return _induced(s, k, small, stars[order])


def permuted_lcp(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position, its common prefix with the suffix before it in the array, counted up to ``most``.

    Where a position and its right neighbour are paired with neighbours and
    agree in their first value, the position's prefix is longer by one. So only
    the last position of such a chain is compared.
    """
    s = np.asarray(s)
    n = len(s)
    out = np.zeros(n, np.int32)
    if n < 2:
        return out
    before = np.full(n, -2, np.int32)
    before[sa[1:]] = sa[:-1]
    linked = before[1:] == before[:-1] + 1
    linked &= s[:-1] == s[before[:-1]]
    ends = np.append(np.flatnonzero(~linked), n - 1)
    words, each = _words(s)
    live = ends[before[ends] >= 0]
    # Eight bytes at a time while they agree and none is past the end.
    fast = live
    while len(fast):
        x, y = fast + out[fast], before[fast] + out[fast]
        ok = np.maximum(x, y) < n - each
        fast, x, y = fast[ok], x[ok], y[ok]
        fast = fast[words[x] == words[y]]
        out[fast] += each
        fast = fast[out[fast] < most]
    live = live[out[live] < most]
    while len(live):
        x, y = live + out[live], before[live] + out[live]
        ok = np.maximum(x, y) < n
        live, x, y = live[ok], x[ok], y[ok]
        live = live[s[x] == s[y]]
        out[live] += 1
        live = live[out[live] < most]
    size = np.diff(ends, prepend=-1)
    return np.minimum(np.repeat(out[ends] + ends, size) - np.arange(n), most).astype(np.int32)


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, the ascending positions at which a string of ``length`` bytes begins that begins elsewhere too."""
    if not strings:
        return []
    raw = np.frombuffer(b"\0".join(strings) + b"\0\0", np.uint8).astype(np.uint16) + 2
    ends = np.cumsum([len(x) + 1 for x in strings])
    raw[ends - 1] = 1  # between strings
    raw[-1] = 0  # the end mark
    used = np.bincount(raw, minlength=258) > 0
    raw = (np.cumsum(used) - 1)[raw].astype(np.uint8 if used.sum() <= 1 << 8 else np.uint16)
    sa = suffix_array(raw, int(used.sum()))
    lcp = permuted_lcp(raw, sa, length)
    hit = np.zeros(len(raw), bool)
    long_ = lcp[sa[1:]] >= length
    hit[sa[1:][long_]] = True
    hit[sa[:-1][long_]] = True
    # No separator lies within a common prefix of full length, for it would have to match one too.
    out = []
    for end, x in zip(ends, strings):
        at = end - 1 - len(x)
        out.append(np.flatnonzero(hit[at : at + max(0, len(x) - length + 1)]))
    return out
