"""Packed shuffles: many 64-bit keys travel as a few binary rows, one per bucket, and are looked up there in numpy.

A task keeps one entry per key and owner, so that no key, however common, sends more entries than there are tasks.
"""

from __future__ import annotations

import numpy as np


def planes(values: np.ndarray) -> bytes:
    """Integers as byte planes, lowest first, no more planes than the largest needs (the first byte says how many)."""
    raw = np.ascontiguousarray(values.astype(np.int64, copy=False) if values.dtype.kind != "u" else values.astype(np.uint64, copy=False))
    width = max(1, (int(raw.view(np.uint64).max()).bit_length() + 7) // 8) if len(raw) else 1
    return bytes([width]) + raw.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(blob: bytes) -> np.ndarray:
    width = blob[0]
    n = (len(blob) - 1) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, offset=1).reshape(width, n).T
    return out.view(np.int64).ravel()


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket, from the top 32 bits; the low 48 bits tell keys of a bucket apart."""
    return ((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)


def cut(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order by bucket, and the starts of the buckets in it (and the end)."""
    order = np.argsort(buckets.astype(np.uint16) if not len(buckets) or buckets.max() < 65536 else buckets, kind="stable")
    ranked = buckets[order]
    return order, np.r_[np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, int), len(ranked)]
