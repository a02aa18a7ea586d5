"""Vectorised words, hashes and n-grams over Arrow text columns; runs inside Spark tasks.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Texts stay UTF-8 bytes: no Python string is made.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
#: Odd multipliers by place in a word and by place in an n-gram.
BYTE_KEYS = _rng.integers(0, 1 << 63, 4096, dtype=np.uint64) * U64(2) + U64(1)
GRAM_KEYS = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)


def give_back() -> None:
    """Returns freed memory to the system: workers are used again, and would keep their highest use on top of the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64 bits."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows, from 0) of a string column; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text stands alone, whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SEPARATORS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (one more than rows)."""
    inside = ~separators[data]
    starts, ends = inside.copy(), inside.copy()
    if len(data):
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        first = offsets[(offsets < len(data))]
        starts[first] = inside[first]
        last = offsets[(offsets > 0)] - 1
        ends[last] = inside[last]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    place = np.cumsum(lengths) - lengths
    k = np.arange(int(lengths.sum())) - np.repeat(place, lengths)
    letters = data[k + np.repeat(starts, lengths)].astype(np.uint64) + U64(1)
    if int(lengths.max()) > len(BYTE_KEYS):
        letters *= BYTE_KEYS[k % len(BYTE_KEYS)] * (k // len(BYTE_KEYS) * 2 + 1).astype(np.uint64)
    else:
        letters *= BYTE_KEYS[k]
    return mix(np.add.reduceat(letters, place) + lengths.astype(np.uint64) * U64(0x9E3779B97F4A7C15))


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place in the row of every run of n words within a row."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = hashes[:m] * GRAM_KEYS[0]
    for k in range(1, n):
        total += hashes[k : k + m] * GRAM_KEYS[k]
    row = rows_of(first)
    whole = row[:m] == row[n - 1 :]
    at = np.flatnonzero(whole)
    return mix(total[at]), row[at], at - first[row[at]]
