"""Counting sketches of sets and the lower bound on how much two sets differ.

A sketch has a byte for each of a power of two of hash ranges: how many items fall there (modulo
32) and the sum of three of their hash bits (modulo 8). Ranges whose counts differ by d hold at
least d differing items; ranges with equal counts but unequal sums hold at least two. The sum over
all ranges never exceeds the true symmetric difference, so a pair above the limit can be let go.
"""

from __future__ import annotations

import numpy as np

#: Items per range, on average, at the coarsest.
PER_RANGE = 2.5


def sketch(items: np.ndarray) -> bytes:
    """Of a set of 64-bit hashes."""
    if not len(items):
        return b""
    bits = max(3, int(np.ceil(np.log2(max(len(items), 2) / PER_RANGE))))
    place = (items >> np.uint64(64 - bits)).astype(np.int64)
    count = np.bincount(place, minlength=1 << bits).astype(np.int64)
    total = np.bincount(place, weights=((items >> np.uint64(8)) & np.uint64(7)).astype(np.float64), minlength=1 << bits).astype(np.int64)
    return ((count & 31) << 3 | (total & 7)).astype(np.uint8).tobytes()


def fold(a: np.ndarray) -> np.ndarray:
    """Half as many ranges; the last axis is folded."""
    count, total = a >> 3, a & 7
    return ((count[..., 0::2] + count[..., 1::2]) & 31) << 3 | ((total[..., 0::2] + total[..., 1::2]) & 7)


def _bounds() -> np.ndarray:
    """By (byte, byte): the least number of items in which such ranges differ."""
    a, b = np.arange(256)[:, None], np.arange(256)[None, :]
    apart = (a >> 3) - (b >> 3) & 31
    apart = np.minimum(apart, 32 - apart)
    return np.where((apart == 0) & (a & 7 != b & 7), 2, apart).astype(np.uint8).ravel()


BOUNDS = _bounds()


def same_width(parts: list[bytes]) -> np.ndarray:
    """Sketches as rows of the least width among them."""
    arrays = [np.frombuffer(p, np.uint8) for p in parts]
    width = min(map(len, arrays))
    for k, a in enumerate(arrays):
        while len(a) > width:
            a = fold(a)
        arrays[k] = a
    return np.stack(arrays)


def least_difference(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Lower bounds between one sketch and each row of ``many``, all of one width."""
    return BOUNDS[(one.astype(np.uint16) << np.uint16(8)) | many].sum(axis=1, dtype=np.int64)
