"""Suffix arrays by induced sorting, and permuted common prefixes.

`suffix_array` classifies suffixes, sorts the leftmost-smaller (LMS) substrings by inducing, names them, recurses on the
names where they repeat, and induces the final order. Both passes go bucket by bucket in numpy: all entries of a bucket
induce together, and those that fall into the same bucket form the next wave. Where the recursion has more than `FEW`
names, buckets are too small for that and ranks of names are refined by doubling instead.
"""

from __future__ import annotations

import numpy as np

FEW = 1024
#: Positions that prefixes are compared for at a time; bounds memory.
BLOCK = 1 << 17


def s_types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last symbol is the only smallest."""
    change = np.flatnonzero(s[1:] != s[:-1])
    return np.append(np.repeat(s[change] < s[change + 1], np.diff(change, prepend=-1)), True)


def spread(entries: np.ndarray, symbol: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Append entries to the buckets of their symbols, in order."""
    if not len(entries):
        return
    order = np.argsort(symbol, kind="stable")
    entries, symbol = entries[order], symbol[order]
    cuts = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
    begin = [0, *cuts.tolist()]
    for a, b in zip(begin, [*begin[1:], len(entries)]):
        into[symbol[a]].append(entries[a:b])


def joined(parts: list[np.ndarray], kind: np.dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def induce_bytes(s: np.ndarray, stype: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """Order of all suffixes induced from LMS positions in the given order."""
    seeds: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    spread(lms, s[lms], seeds)
    large: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    for c in range(symbols):
        wave, mine = joined(large[c], lms.dtype), []
        while len(wave):
            mine.append(wave)
            j = wave[wave > 0] - 1
            j = j[~stype[j]]
            same = s[j] == c
            spread(j[~same], s[j[~same]], large)
            wave = j[same]
        large[c] = [joined(mine, lms.dtype)]
        j = joined(seeds[c], lms.dtype)
        j = j[j > 0] - 1
        spread(j, s[j], large)
    small: list[list[np.ndarray]] = [[] for _ in range(symbols)]  # each in descending order
    for c in range(symbols - 1, -1, -1):
        wave, mine = joined(small[c], lms.dtype), []
        while len(wave):
            mine.append(wave)
            j = wave[wave > 0] - 1
            j = j[stype[j]]
            same = s[j] == c
            spread(j[~same], s[j[~same]], small)
            wave = j[same]
        small[c] = [joined(mine, lms.dtype)]
        j = large[c][0][::-1]
        j = j[j > 0] - 1
        j = j[stype[j]]
        spread(j, s[j], small)
    out = [np.array([len(s) - 1], lms.dtype)]  # the last symbol, alone in bucket 0
    for c in range(1, symbols):
        out += [large[c][0], small[c][0][::-1]]
    return np.concatenate(out)


def refine(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string of many different names: ranks of runs of names, doubled until all differ.

    Only positions whose rank is still shared are sorted again, so text without long repeats takes two or three rounds.
    """
    n = len(names)
    order = np.argsort(names, kind="stable")
    sorted_names = names[order]
    new = np.concatenate([[True], sorted_names[1:] != sorted_names[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[n] = -1
    shared = np.flatnonzero(~(new & np.append(new[1:], True)))
    k = 1
    while len(shared):  # places of the order that hold shared ranks
        at = order[shared]
        key = rank[at] * (n + 1) + rank[np.minimum(at + k, n)] + 1
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[shared] = at
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = shared[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        shared = shared[~(first & np.append(first[1:], True))]
        k *= 2
    return order


def lms_names(s: np.ndarray, lms: np.ndarray, ranked: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order, from their sorted order; and how many differ."""
    number = np.full(len(s), -1, lms.dtype)
    number[lms] = np.arange(len(lms), dtype=lms.dtype)
    size = np.append(lms[1:] - lms[:-1] + 1, 1)
    order = number[ranked]
    a, b = order[:-1], order[1:]
    differ = size[a] != size[b]
    live = np.flatnonzero(~differ)
    k = 0
    while len(live):
        unlike = s[lms[a[live]] + k] != s[lms[b[live]] + k]
        differ[live[unlike]] = True
        live = live[~unlike]
        k += 1
        live = live[size[a[live]] > k]
    names = np.empty(len(lms), np.int64)
    rank = np.concatenate([[0], np.cumsum(differ)])
    names[order] = rank
    return names, int(rank[-1]) + 1


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of symbols 0 .. symbols - 1; the last one is 0 and occurs nowhere else."""
    s = s.astype(np.uint16 if symbols <= 1 << 16 else np.int64, copy=False)  # short symbols are sorted by radix
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    stype = s_types(s)
    lms = (np.flatnonzero(stype[1:] & ~stype[:-1]) + 1).astype(np.int32 if n < 1 << 31 else np.int64)
    first = induce_bytes(s, stype, lms, symbols)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = first[is_lms[first]]
    del first, is_lms
    names, distinct = lms_names(s, lms, ranked)
    if distinct < len(lms):
        ranked = lms[suffix_array(names, distinct) if distinct <= FEW else refine(names)]
    return induce_bytes(s, stype, ranked, symbols)


def common_prefixes(data: np.ndarray, sa: np.ndarray, most: int, fresh: np.ndarray) -> np.ndarray:
    """PLCP up to `most`: common prefix of each suffix (by position) with the one before it in the array.

    Only irreducible positions are compared, eight bytes at a time; after one of them the value falls by one with every
    step. `fresh` marks positions that are compared in any case (the starts of texts).
    """
    n = len(data)
    before = np.full(n, -1, sa.dtype)
    before[sa[1:]] = sa[:-1]
    own = fresh | (before <= 0)
    value = np.zeros(n, sa.dtype)
    raw = np.concatenate([data, np.full(8, 0, np.uint8)])
    eight = np.ndarray((n + 1,), "<u8", raw, strides=(1,))
    for i in range(0, n, BLOCK):
        part = slice(i, i + BLOCK)
        rest = np.flatnonzero(~own[part]) + i
        own[rest] = (rest == 0) | (data[rest - 1] != data[before[rest] - 1])
        live, k = np.flatnonzero(own[part] & (before[part] >= 0)) + i, 0
        while len(live) and k < most:
            p, q = live + k, before[live] + k
            fits = np.maximum(p, q) < n
            diff = np.where(fits, eight[np.minimum(p, n)] ^ eight[np.minimum(q, n)], np.uint64(1))
            low = diff & (~diff + np.uint64(1))
            got = np.where(diff == 0, 8, (np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64))
            value[live] = k + np.where(fits, got, 0)
            live = live[fits & (diff == 0)]
            k += 8
    x = np.arange(n, dtype=sa.dtype)
    last = np.where(own, x, 0)
    np.maximum.accumulate(last, out=last)
    value = np.minimum(value[last], most)
    value += last
    value -= x
    return np.maximum(value, 0, out=value)
