"""Suffix arrays by induced sorting, in whole-array steps.

Suffixes are classified as smaller or larger than their successor; the leftmost-smaller
(LMS) substrings are put in order by one induction and named, the order of the LMS
suffixes follows by sorting names, then pairs of names, then pairs of pairs, and so on,
and a second induction fills in all other suffixes. An induction visits the buckets of
first characters in turn and handles a whole bucket (or the part of it that is induced
from itself) at once. Common prefixes are computed in text order (the permuted array).
"""

from __future__ import annotations

import numpy as np

from .common import code_powers, mix

_WORD = 8


def classify(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their successor; the last one (the sentinel) counts as such."""
    change = np.flatnonzero(s[1:] != s[:-1])
    small = np.zeros(len(s), bool)
    if len(change):
        small[:change[-1] + 1] = np.repeat(s[change] < s[change + 1], np.diff(change, prepend=-1))
    small[-1] = True
    return small


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, given the LMS ones in order."""
    n = len(s)
    sa = np.full(n, -1, np.int32)
    count = np.bincount(s, minlength=size)
    tail = np.cumsum(count)
    head = tail - count

    def put(positions: np.ndarray, at: np.ndarray, up: bool) -> None:
        """Append positions, in order, to the front (or back) ends of their buckets."""
        c = s[positions]
        order = np.argsort(c, kind="stable")                    # a radix sort on bytes
        num = np.bincount(c, minlength=size)
        kinds = np.flatnonzero(num)
        num = num[kinds]
        first = np.cumsum(num) - num
        if up:
            sa[np.arange(len(c)) + np.repeat(at[kinds] - first, num)] = positions[order]
            at[kinds] += num
        else:
            sa[np.repeat(at[kinds] - 1 + first, num) - np.arange(len(c))] = positions[order]
            at[kinds] -= num

    put(lms[::-1], tail.copy(), False)
    lms_from = np.cumsum(count) - np.bincount(s[lms], minlength=size)
    present = np.flatnonzero(count)
    front = head.copy()
    for c in present.tolist():                                  # larger suffixes, left to right
        done = head[c]
        while done < front[c]:
            block = sa[done:front[c]]
            done = int(front[c])
            prev = block[block > 0] - 1
            prev = prev[~small[prev]]
            if len(prev):
                put(prev, front, True)
        block = sa[lms_from[c]:tail[c]]
        prev = block[block > 0] - 1
        prev = prev[~small[prev]]
        if len(prev):
            put(prev, front, True)
    back = tail.copy()
    larger_to = front                                           # ends of the larger parts
    back_done = tail.copy()
    for c in present[::-1].tolist():                            # smaller suffixes, right to left
        while back_done[c] > back[c]:
            block = sa[back[c]:back_done[c]][::-1]
            back_done[c] = back[c]
            prev = block[block > 0] - 1
            prev = prev[small[prev]]
            if len(prev):
                put(prev, back, False)
        block = sa[head[c]:larger_to[c]][::-1]
        prev = block[block > 0] - 1
        prev = prev[small[prev]]
        if len(prev):
            put(prev, back, False)
    sa[0] = n - 1                                               # the sentinel
    return sa


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Name of each LMS substring (equal ones alike, in order), by position in ``lms``: the
    number of substrings that are smaller."""
    n = len(s)
    power, inverse = code_powers(n)
    code = mix(np.arange(int(s.max()) + 1, dtype=np.uint64) + np.uint64(0xBF58476D1CE4E5B9))
    hashes = np.zeros(n + 1, np.uint64)
    np.cumsum(code[s] * power, out=hashes[1:])
    end = np.append(lms[1:], n - 1) + 1
    length = (end - lms).astype(np.int32)
    h = (hashes[end] - hashes[lms]) * inverse[lms]
    place = np.empty(n, np.int32)
    place[lms] = np.arange(len(lms), dtype=np.int32)
    o = place[ordered]
    h, length = h[o], length[o]
    name = np.empty(len(lms), np.int64)
    name[o] = _smaller((h[1:] != h[:-1]) | (length[1:] != length[:-1]))
    return name


def _smaller(new: np.ndarray) -> np.ndarray:
    """For each entry of a sorted list the number of smaller ones; ``new`` tells where
    an entry differs from the one before it."""
    start = np.concatenate(([0], np.flatnonzero(new) + 1))
    return np.repeat(start, np.diff(np.append(start, len(new) + 1)))


def _tied(name: np.ndarray) -> np.ndarray:
    """Places of the names that are given more than once."""
    return np.flatnonzero(np.bincount(name)[name] > 1)


def suffix_array(s: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of ``s`` (integers below ``size``) that ends in a sentinel 0, which
    must occur nowhere else."""
    if len(s) == 1:
        return np.zeros(1, np.int64)
    small = classify(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    first = induce(s, small, lms, size)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    name = _names(s, lms, first[is_lms[first]])
    step, m = 1, len(lms)
    tied = _tied(name)
    while len(tied):                                            # order of name pairs, then of pairs of pairs
        follower = tied + step
        second = np.where(follower < m, name[np.minimum(follower, m - 1)] + 1, 0)
        key = name[tied] * (m + 1) + second
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        # names count the smaller ones, so those of a group begin at its old name
        old = name[tied]
        place = np.arange(len(tied)) - _smaller(old[1:] != old[:-1])
        name[tied] = old + place[_smaller(key[1:] != key[:-1])]
        tied = np.sort(tied)
        tied = tied[_tied(name[tied])]
        step *= 2
    ordered = np.empty(m, np.int64)
    ordered[name] = lms
    return induce(s, small, ordered, size)


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, cap: int, least: int = 0) -> np.ndarray:
    """For each position of a byte text the length, up to ``cap``, of the prefix that its
    suffix shares with the one before it in order; 0 for the first suffix. Eight bytes
    are compared at a time, and only pairs that still agree go on. Pairs whose eight bytes
    before ``least`` differ share less than that; they get 0 and are not looked at further."""
    n = len(text)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    eight = np.concatenate((text, np.zeros(cap + _WORD, np.uint8))).astype(np.uint64)
    for shift in (1, 2, 4):
        eight = eight[:-shift] | eight[shift:] << np.uint64(8 * shift)
    out = np.zeros(n, np.int32)
    live = np.flatnonzero(before >= 0).astype(np.int32)
    other = before[live]
    if _WORD <= least <= cap:
        agree = eight[live + (least - _WORD)] == eight[other + (least - _WORD)]
        live, other = live[agree], other[agree]
    for at in range(0, cap, _WORD):
        differ = eight[live + at] ^ eight[other + at]
        same = differ == 0
        end, bits = live[~same], differ[~same]
        lowest = bits & (~bits + np.uint64(1))                  # the first byte that differs has the lowest set bit
        out[end] = at + (np.log2(lowest.astype(np.float64)).astype(np.int32) >> 3)
        live, other = live[same], other[same]
        if not len(live):
            break
    out[live] = cap
    return np.minimum(np.minimum(out, cap), np.minimum(n - np.arange(n), np.where(before >= 0, n - before, 0)))
