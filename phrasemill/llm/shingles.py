"""Word shingles of texts as sets of 64-bit values, computed for many whole texts at once.

Texts are read where Arrow holds them: the bytes of a slice of rows are one array, and words, shingles
and sets of all its texts come out of the same few array operations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from phrasemill.llm.common import mix

WIDTH = 5
#: Bytes of text in one slice, about; the work arrays of a slice should fit a core's cache.
SLICE = 1 << 15
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word up to which its value is made with those of all words; a longer one is digested alone.
_LONG = 256
#: What masks the first 0 to 8 bytes of a little-endian long.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def words(text: str | None) -> list[bytes]:
    """A-Z in lower case, cut at ASCII white space; both are what ``bytes`` does."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and where each text begins; a null is empty."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), ends


def _slices(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts that begin within ``SLICE`` bytes; a longer text ends its range."""
    at, rows = 0, len(ends) - 1
    while at < rows:
        after = min(max(int(np.searchsorted(ends, ends[at] + SLICE)), at + 1), rows)
        yield at, after
        at = after


def _edges(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts that stand one behind the other begin and end; none goes across."""
    inside = (raw != 32) & (raw - np.uint8(9) > 4)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = bounds[1:] > bounds[:-1]
    at, end = bounds[:-1][filled], bounds[1:][filled] - 1
    first[at] = inside[at]
    last[end] = inside[end]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_counts(texts: pa.Array) -> np.ndarray:
    """The number of words of each text."""
    raw, ends = _bytes(texts)
    out = np.zeros(len(ends) - 1, np.int64)
    for a, b in _slices(ends):
        starts, _ = _edges(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
        out[a:b] = np.diff(np.searchsorted(starts, ends[a : b + 1] - ends[a]))
    return out


def _word_values(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit value for each word, from its bytes alone: eight at a time, then their number."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lower = np.zeros(len(raw) + 8, np.uint8)
    lower[:-8] = raw + ((raw - np.uint8(65) < 26).view(np.uint8) << 5)
    eight = np.ndarray(len(raw) + 1, "<u8", lower, strides=(1,))  # those from each byte on
    size = ends - starts
    value = mix(eight[starts] & _FIRST.take(np.minimum(size, 8)))
    left = np.flatnonzero(size > 8)
    for k in range(8, _LONG, 8):
        if not len(left):
            break
        part = eight[starts[left] + k] & _FIRST.take(np.minimum(size[left] - k, 8))
        value[left] = mix(value[left] * _BASE + part)
        left = left[size[left] > k + 8]
    for i in left.tolist():
        own = hashlib.blake2b(lower[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        value[i] = int.from_bytes(own, "little")
    return mix(value + size.astype(np.uint64))


def _joined(value: np.ndarray, size: int) -> np.ndarray:
    """The shingle of ``size`` words that begins at each word, as far as there are so many."""
    out = value[: len(value) - size + 1].copy()
    for k in range(1, size):
        out *= _BASE
        out += value[k : len(value) - size + 1 + k]
    return mix(out + np.uint64(size))


def _sets(raw: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = _edges(raw, bounds)
    value = _word_values(raw, starts, ends)
    word = np.searchsorted(starts, bounds)
    n = np.diff(word)
    short = (n > 0) & (n < width)
    sizes = np.where(short, 1, np.maximum(n - width + 1, 0))
    place = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(place[-1], np.uint64)
    # of each text its first words up to where a shingle still fits; a short text has one shingle
    at = np.arange(place[-1]) + np.repeat(word[:-1] - place[:-1], sizes)
    if short.any():
        whole = np.repeat(~short, sizes)
        if whole.any():
            out[whole] = _joined(value, width)[at[whole]]
        for size in np.unique(n[short]).tolist():
            few = np.flatnonzero(n == size)
            out[place[few]] = _joined(value, size)[word[few]]
    elif len(at):
        out = _joined(value, width)[at]
    for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True):
        out[a:b].sort()
    kept = np.ones(len(out), bool)
    kept[1:] = out[1:] != out[:-1]
    kept[place[:-1][sizes > 0]] = True
    return out[kept], np.concatenate([[0], np.cumsum(kept)])[place]


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row behind, values, bounds)`` for slices of rows: the values of row ``first + i``,
    those of :func:`shingle_set`, are ``values[bounds[i] : bounds[i + 1]]``."""
    raw, ends = _bytes(texts)
    for a, b in _slices(ends):
        yield a, b, *_sets(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a], width)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingles of ``width`` words; the whole sequence if there are fewer."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return _sets(raw, np.array([0, len(raw)]), width)[0]


def shingle_texts(text: str | None, width: int = WIDTH) -> set[bytes]:
    """The same set as words joined by one space: the plain form that links are verified on."""
    w = words(text)
    size = min(width, len(w))
    return {b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
