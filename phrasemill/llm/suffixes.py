"""Suffix arrays by induced sorting and permuted common prefixes, over NumPy vectors.

Suffixes are classed as smaller (S) or larger (L) than their right neighbour. The leftmost S suffixes
(LMS) split the text into substrings that are sorted and named; if names repeat, the string of names
is sorted by the same function. From the sorted LMS suffixes the L suffixes are induced from left to
right, then the S suffixes from right to left. Over bytes this is one scan over the buckets of each
pass, linear in the text, with a bucket's suffixes handled at once. Strings of names have too many
buckets for that, so there a suffix is placed by its run of one type up to the next suffix of the other.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are scanned by buckets.
BUCKETS = 1 << 10


def _classes(text: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last one, of the sentinel, is one."""
    n = len(text)
    smaller = np.ones(n, bool)
    if n > 1:
        decided = np.where(text[:-1] != text[1:], np.arange(n - 1), n - 2)
        following = np.minimum.accumulate(decided[::-1])[::-1]
        smaller[:-1] = (text[:-1] < text[1:])[following]
    return smaller


def _ordered(cells: np.ndarray, starts: np.ndarray, stops: np.ndarray, top: int) -> np.ndarray:
    """Ranks of the strings ``cells[start..stop]``, none a prefix of another; equal ones share one.

    Several cells are compared at a time, and only strings that are still tied go on.
    """
    bits = int(top + 1).bit_length()
    per = max(63 // bits, 1)
    rank = np.zeros(len(starts), np.int64)
    active, at = np.arange(len(starts)), starts.copy()
    while len(active):
        word = np.zeros(len(active), np.int64)
        for k in range(per):
            place = at[active] + k
            inside = place <= stops[active]
            word = (word << bits) | np.where(inside, cells[np.where(inside, place, 0)] + 1, 0)
        order = np.lexsort((word, rank[active]))
        active, word = active[order], word[order]
        old = rank[active]
        other = np.append(True, old[1:] != old[:-1])
        fresh = other | np.append(True, word[1:] != word[:-1])
        i = np.arange(len(active))
        first = np.maximum.accumulate(np.where(fresh, i, 0))
        rank[active] = old + first - np.maximum.accumulate(np.where(other, i, 0))
        alone = fresh & np.append(fresh[1:], True)
        at[active] += per
        active = active[~alone & (at[active] <= stops[active])]
    return rank


def _induced_by_buckets(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The suffix array from the sorted LMS suffixes, by one scan over the buckets for each type."""
    count = np.bincount(text, minlength=size)
    tail = np.cumsum(count)
    head = tail - count
    out = np.full(len(text), -1, np.int64)
    letters = text.astype(np.uint16)
    by_letter = lms[np.argsort(letters[lms], kind="stable")]
    n_lms = np.bincount(text[lms], minlength=size)
    lms_end = np.cumsum(n_lms)

    def placed(suffixes: np.ndarray, kind: bool):
        """The left neighbours of one type with their letters, and their places among equal letters."""
        left = suffixes[suffixes > 0] - 1
        left = left[smaller[left] == kind]
        letter = letters[left]
        order = np.argsort(letter, kind="stable")
        left, letter = left[order], letter[order].astype(np.int64)
        n = np.bincount(letter, minlength=size)
        return left, letter, np.arange(len(left)) - (np.cumsum(n) - n)[letter], n

    used = head.copy()
    for c in np.flatnonzero(count):
        at = head[c]
        while at < used[c]:
            part, at = out[at : used[c]], used[c]
            left, letter, place, n = placed(part, False)
            out[used[letter] + place] = left
            used += n
        left, letter, place, n = placed(by_letter[lms_end[c] - n_lms[c] : lms_end[c]], False)
        out[used[letter] + place] = left
        used += n
    free = tail.copy()
    out[0] = len(text) - 1  # the sentinel's bucket
    free[text[-1]] -= 1
    for c in np.flatnonzero(count)[::-1]:
        at = tail[c]
        while at > free[c]:
            part, at = out[free[c] : at][::-1].copy(), free[c]
            left, letter, place, n = placed(part, True)
            out[free[letter] - 1 - place] = left
            free -= n
        left, letter, place, n = placed(out[head[c] : used[c]][::-1], True)
        out[free[letter] - 1 - place] = left
        free -= n
    return out


def _induced_by_runs(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The same for large alphabets: a run of one type and the rank of what follows decide."""
    n = len(text)
    cells = 2 * text + smaller
    i = np.arange(n)
    rank = np.zeros(n, np.int64)
    rank[lms] = np.arange(len(lms))
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    next_lms = np.minimum.accumulate(np.where(is_lms, i, n)[::-1])[::-1]
    larger = np.flatnonzero(~smaller)
    stop = next_lms[larger]
    larger = larger[np.lexsort((rank[stop], _ordered(cells, larger, stop, 2 * size)))]
    rank[larger] = np.arange(len(larger))
    next_l = np.minimum.accumulate(np.where(smaller, n, i)[::-1])[::-1]
    small = np.flatnonzero(smaller)
    stop = np.where(next_l[small] < n, next_l[small], small)
    small = small[np.lexsort((rank[stop], _ordered(cells, small, stop, 2 * size)))]
    both = np.concatenate((larger, small))  # in a bucket L suffixes come first
    return both[np.argsort(text[both], kind="stable")]


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Suffixes of ``text`` in order. Its last value is the only 0; all are below ``size``."""
    n = len(text)
    smaller = _classes(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) > 1:
        stops = np.append(lms[1:], n - 1)
        rank = _ordered(2 * text + smaller, lms, stops, 2 * size)
        order = np.argsort(rank, kind="stable")
        fresh = np.append(False, np.diff(rank[order]) != 0)
        names = np.empty(len(lms), np.int64)
        names[order] = np.cumsum(fresh)
        distinct = int(fresh.sum()) + 1
        if distinct < len(lms):
            order = suffix_array(names, distinct)
        lms = lms[order]
    induce = _induced_by_buckets if size <= BUCKETS else _induced_by_runs
    return induce(text, smaller, lms, size)


def common_prefixes(text: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """For each suffix, in text order, what it shares with the one before it in ``array``, up to ``most``.

    Permuted common prefixes: from one place to the next the value falls by one at most, and exactly by
    one unless the letters to the left differ. So only those places are compared, eight bytes at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    i = np.arange(n)
    known = (before > 0) & (i > 0)
    known[known] = text[i[known] - 1] == text[before[known] - 1]
    open_ = np.flatnonzero(~known & (before >= 0))
    shared = np.zeros(n, np.int64)
    padded = np.concatenate((text, np.zeros(8, text.dtype)))
    words = [padded[k : k + n + 1] for k in range(8)]
    at = 0
    while len(open_):
        x, y = open_ + at, before[open_] + at
        inside = (x < n) & (y < n)
        x, y, open_ = x[inside], y[inside], open_[inside]
        same = np.ones(len(x), bool)
        run = np.zeros(len(x), np.int64)
        for word in words:
            same &= word[x] == word[y]
            run += same
        shared[open_] += run
        open_ = open_[same]
        at += 8
    start = np.maximum.accumulate(np.where(known, -1, i))
    return np.minimum(np.maximum(shared[start] - (i - start), 0), most) if n else shared
