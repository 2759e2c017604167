"""Suffix arrays of one shard by induced sorting, and its permuted common prefixes, in whole-array steps."""

from __future__ import annotations

import numpy as np

from .common import ship

ship(__name__)

#: Symbols packed into one word for comparisons; a symbol has nine bits.
PACK = 7
#: Symbol after the end of a substring: larger than all others.
AFTER = 511


def classify(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (type S).  The last symbol of ``t`` is its only least one."""
    n = len(t)
    differs = np.flatnonzero(t[:-1] != t[1:])
    following = np.full(n, n - 1)
    following[:-1] = differs[np.minimum(np.searchsorted(differs, np.arange(n - 1)), len(differs) - 1)] if len(differs) else n - 1
    small = np.empty(n, bool)
    small[:-1] = t[following[:-1]] < t[np.minimum(following[:-1] + 1, n - 1)]
    small[-1] = True
    return small


def packed(t: np.ndarray) -> np.ndarray:
    """For each place the ``PACK`` symbols from there on in one number that sorts like them."""
    n = len(t)
    padded = np.concatenate([t.astype(np.uint64), np.zeros(PACK, np.uint64)])
    words = np.zeros(n, np.uint64)
    for k in range(PACK):
        words |= padded[k : k + n] << np.uint64(9 * (PACK - 1 - k))
    return words


def _dense(sorted_keys: list[np.ndarray]) -> np.ndarray:
    """For sorted keys the place of the first equal one."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _refine(rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Split the groups of equal rank among the active by the key; returns those still in a group of two or more."""
    order = np.lexsort((key, rank[active]))
    at, old, key = active[order], rank[active][order], key[order]
    group, inner = _dense([old]), _dense([old, key])
    rank[at] = old + inner - group
    again = np.zeros(len(at), bool)
    same = inner[1:] == inner[:-1]
    again[1:] |= same
    again[:-1] |= same
    return at[again]


def sorted_lms(t: np.ndarray, words: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The leftmost-smaller suffixes in order: their substrings are named, then names are joined in pairs, recursively, until all differ."""
    m = len(lms)
    length = np.append(np.diff(lms) + 1, 1)  # a substring ends with the next one's first symbol
    rank, active, offset = np.zeros(m, np.int64), np.arange(m), 0
    while len(active):
        left = length[active] - offset
        key = words[np.minimum(lms[active] + offset, len(t) - 1)].copy()
        for k in range(PACK):  # what comes after the end: first a symbol above all others, then nothing
            shift = np.uint64(9 * (PACK - 1 - k))
            ended = left == k
            key[ended] = (key[ended] >> (shift + np.uint64(9)) << (shift + np.uint64(9)) if k else np.uint64(0)) | (np.uint64(AFTER) << shift)
        key[left < 0] = 0
        active = _refine(rank, active, key)
        offset += PACK
        active = active[length[active] >= offset]
    # equal substrings have equal ranks; what follows them decides
    order = np.argsort(rank, kind="stable")
    first = _dense([rank[order]])
    several = np.zeros(m, bool)
    several[order[1:]] |= first[1:] == first[:-1]
    several[order[:-1]] |= first[1:] == first[:-1]
    active, step = np.flatnonzero(several), 1
    while len(active):
        behind = active + step
        key = np.where(behind < m, rank[np.minimum(behind, m - 1)] + 1, 0).astype(np.uint64)
        active, step = _refine(rank, active, key), step * 2
    out = np.empty(m, np.int64)
    out[rank] = lms
    return out


def _place(sa: np.ndarray, t: np.ndarray, found: np.ndarray, ends: np.ndarray, step: int) -> None:
    """Put suffixes at the open ends of their buckets, in order: from the left (step 1) or from the right (-1)."""
    bucket = t[found]
    order = np.argsort(bucket, kind="stable")
    found, bucket = found[order], bucket[order]
    offset = np.arange(len(found)) - _dense([bucket])
    sa[ends[bucket] + step * offset] = found
    ends += step * np.bincount(bucket, minlength=len(ends))


def suffix_array(t: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Suffix array of ``t`` (uint16 below ``AFTER``, its last symbol the only 0)."""
    n, small = len(t), classify(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    seeds = sorted_lms(t, words, lms)
    counts = np.bincount(t)
    heads, tails = np.cumsum(counts) - counts, np.cumsum(counts) - 1
    sa = np.full(n, -1)
    by_bucket = np.split(seeds[np.argsort(t[seeds], kind="stable")], np.cumsum(np.bincount(t[seeds], minlength=len(counts)))[:-1])
    # larger types, bucket by bucket from the left; a bucket's own arrivals form waves
    ends = heads.copy()
    for c in np.flatnonzero(counts):
        done = heads[c]
        while done < ends[c]:
            wave, done = sa[done : ends[c]], ends[c]
            before = wave[wave > 0] - 1
            _place(sa, t, before[~small[before]], ends, 1)
        before = by_bucket[c] - 1
        _place(sa, t, before[(before >= 0) & ~small[before]], ends, 1)
    # smaller types from the right
    larger = ends.copy()  # of each bucket, the end of its larger types
    ends = tails.copy()
    sa[0] = n - 1
    for c in np.flatnonzero(counts)[::-1]:
        done = tails[c]
        while done > ends[c]:
            wave, done = sa[ends[c] + 1 : done + 1][::-1], ends[c]
            before = wave[wave > 0] - 1
            _place(sa, t, before[small[before]], ends, -1)
        wave = sa[heads[c] : larger[c]][::-1]
        before = wave[wave > 0] - 1
        _place(sa, t, before[small[before]], ends, -1)
    sa[0] = n - 1
    return sa


def common_prefixes(t: np.ndarray, words: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of the prefix that its suffix shares with the one before it in order, and that one's place.

    Where the symbols before both are equal the length is one less than the place before; others are compared."""
    n = len(t)
    before = np.full(n, n - 1)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    own = (at == 0) | (before == 0) | (t[at - 1] != t[before - 1])
    own[sa[0]] = True
    length = np.zeros(n, np.int64)
    active = np.flatnonzero(own & (at != sa[0]))
    while len(active):
        a, b = active + length[active], before[active] + length[active]
        inside = (a < n) & (b < n)
        active, a, b = active[inside], a[inside], b[inside]
        x = words[a] ^ words[b]
        equal = x == 0
        # the highest differing bit tells how many whole symbols agree
        high = np.frexp((x[~equal] >> np.uint64(9)).astype(np.float64) * 512 + (x[~equal] & np.uint64(511)).astype(np.float64))[1]
        length[active[~equal]] += (9 * PACK - np.minimum(high, 9 * PACK)) // 9
        active = active[equal]
        length[active] += PACK
    source = np.maximum.accumulate(np.where(own, at, 0))
    return np.maximum(length[source] - (at - source), 0), before


def repeated_starts(segments: list[bytes], size: int) -> list[np.ndarray]:
    """For each segment the starts of its ``size``-byte strings that start in two places or more of all segments."""
    parts = []
    for s in segments:
        parts += [np.frombuffer(s, np.uint8).astype(np.uint16) + 2, np.ones(1, np.uint16)]
    t = np.concatenate([*parts, np.zeros(1, np.uint16)])
    words = packed(t)
    length, before = common_prefixes(t, words, suffix_array(t, words))
    twice = length >= size
    twice[before[twice]] = True
    out, start = [], 0
    for s in segments:
        out.append(np.flatnonzero(twice[start : start + max(0, len(s) - size + 1)]))
        start += len(s) + 1
    return out
