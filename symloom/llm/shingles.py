"""Word-shingle sets as sorted 64-bit hashes, by numpy over the bytes of many texts at once.

Words are runs of bytes other than blank and 0x09-0x0D after lower-casing A-Z. A set has one hash
per distinct run of five words; a text of one to four words has one for its whole sequence; a text
without words has none. Word hashes come from prefix sums of a polynomial with random byte values,
so the cost is a few array passes per byte.
"""

from __future__ import annotations

import numpy as np
import xxhash

SIZE = 5
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
_STEP = np.uint64(0xD6E8FEB86659FD93)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64, kept and grown as needed."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        _POWERS[base] = have = np.cumprod(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """One sorted array of distinct shingle hashes per text."""
    raw = b"".join(t.lower() + b" " for t in texts)
    data = np.frombuffer(raw, np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=total[1:])
    word = mix((total[stop] - total[start]) * powers(_INVERSE, len(data) + 1)[start] + (stop - start).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    upto = np.searchsorted(start, ends)  # words before each text's end
    run = np.zeros(0, np.uint64)
    if len(word) >= size:
        run = word[: len(word) - size + 1].copy()
        for k in range(1, size):
            run = run * _STEP + word[k : len(word) - size + 1 + k]
        run = mix(run)
    out, first = [], 0
    for last in upto:
        n = last - first
        if n >= size:
            out.append(np.unique(run[first : last - size + 1]))
        elif n:
            h = word[first : first + 1].copy()
            for k in range(1, n):
                h = h * _STEP + word[first + k]
            out.append(mix(h + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        first = last
    return out


def set_id(items: np.ndarray) -> int | None:
    """A signed 64-bit name of a set; none for the empty set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(items.tobytes())))) if len(items) else None


def slices(texts: list[bytes], most: int = 1 << 20):
    """Runs of rows of about ``most`` bytes."""
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)
