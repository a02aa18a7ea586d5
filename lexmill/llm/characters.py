"""Characters of Arrow text columns as numpy code points, letters in lower case and all else as a space; inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from .words import U64, buffers, slices

GRAM_KEYS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@cache
def letter_table() -> np.ndarray:
    """By code point: its lower-case letter (if that is one character), or a space for what is no letter."""
    table = np.full(0x110000, 0x20, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def letters(column: pa.Array, carry: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points and rows, about `most` bytes at a time. A longer text comes in parts, each but its first after the last
    `carry` characters of the part before, given row -1 there."""
    table = letter_table()
    data, offsets = buffers(column)
    for i, j in slices(offsets, most):
        begin, end, kept = int(offsets[i]), int(offsets[j]), np.zeros(0, np.uint32)
        while begin < end:
            stop = min(end, begin + 2 * most)
            while stop < end and data[stop] & 0xC0 == 0x80:
                stop -= 1
            part = data[begin:stop]
            codes = table[np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
            heads = np.flatnonzero(part & 0xC0 != 0x80)
            row = np.searchsorted(offsets[i : j + 1], heads + begin, "right") - 1 + i
            yield np.r_[kept, codes], np.r_[np.full(len(kept), -1), row]
            kept = codes[max(0, len(codes) - carry) :] if stop < end else kept[:0]
            begin = stop


def character_grams(codes: np.ndarray, row: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash (of `bits` bits) and row of each run of n characters of one text that isn't all spaces.

    A run that began in the part before belongs to the row of its last character.
    """
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = codes.astype(np.uint64)
    total, some = np.full(m, n, np.uint64), np.zeros(m, bool)
    for k in range(n):
        total = (total ^ wide[k : k + m]) * GRAM_KEYS[k]
        some |= codes[k : k + m] != 0x20
    last = row[n - 1 :]
    keep = np.flatnonzero(some & (last >= 0) & ((row[:m] == last) | (row[:m] == -1)))
    return ((total[keep] * GRAM_KEYS[3]) >> U64(64 - bits)).astype(np.int64), last[keep]
