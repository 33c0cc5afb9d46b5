"""Anchors of fixed-length byte windows.

The anchor of a window is its ``GRAM``-byte string of least hash, the leftmost of equal ones: equal
windows have equal anchors at equal places, so only windows that share an anchor string can be
equal. Neighbouring windows mostly share one anchor occurrence; they form a run.
"""

from __future__ import annotations

import numpy as np

from symloom.llm.shingles import _BASE, _BYTE, _INVERSE, mix, powers

LENGTH, GRAM = 200, 64
_PLACE = 24  # bits for a position; longer texts are cut into overlapping parts
_MASK = np.uint64((1 << _PLACE) - 1)


def runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, its position, first window, last window) of every run."""
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    part = (1 << _PLACE) - length
    if n > part + length - 1:
        out = []
        for at in range(0, n - length + 1, part):
            h, a, lo, hi = runs(data[at : at + part + length - 1], length, gram)
            out.append((h, a + at, lo + at, hi + at))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, n), out=total[1:])
    code = mix((total[gram:] - total[:-gram]) * powers(_INVERSE, n - gram + 1))
    least = (code & ~_MASK) | np.arange(len(code), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: have - width], least[width - have :])
    place = (least & _MASK).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    anchor = place[first]
    return code[anchor], anchor, first, np.append(first[1:], len(place)) - 1
