"""Dynamic programming over pairs of profiles, numpy along anti-diagonals.

Three states per cell: M (both sides advance), U (side one alone), L (side two alone). A cell of a
diagonal needs only the two diagonals before it, so every step is a few array operations over a
whole diagonal and over all pairs of a batch. Pairs of a batch are padded to one shape: cells never
look at cells with a greater index, so padding changes nothing that is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from symloom.model import PAIR_MODES, KernelError

MM, MU, ML, U_OPEN, U_MORE, L_OPEN, L_MORE = (1 << k for k in range(7))
_LOW = np.float32(-np.inf)


@dataclass
class Filled:
    """Scores and traceback flags by state, each (pairs, rows, columns)."""

    scores: tuple[np.ndarray, np.ndarray, np.ndarray]
    traces: tuple[np.ndarray, np.ndarray, np.ndarray] | None


def match_grid(one: list[np.ndarray], two: list[np.ndarray], matrices: list[np.ndarray]) -> np.ndarray:
    """Sum over track sets of profile one . scores . profile two, float32."""
    if not len(one) == len(two) == len(matrices):
        raise KernelError("as many track sets as score matrices are needed on both sides")
    out = np.zeros((len(one[0]), len(two[0])), dtype=np.float32)
    for p, q, s in zip(one, two, matrices, strict=True):
        if s.ndim != 2:
            raise KernelError("pairwise alignment takes two-dimensional score matrices")
        out += (p.astype(np.float32) @ s @ q.astype(np.float32).T).astype(np.float32)
    return out


def gap_grid(length: int, gaps: tuple[float, float]) -> np.ndarray:
    """(open, extend) per position."""
    return np.tile(np.array(gaps, dtype=np.float32), (length, 1))


def fill(
    match: np.ndarray, gap_one: np.ndarray, gap_two: np.ndarray, mode: str, masked: np.ndarray | None = None, trace: bool = True, free_local: bool = False
) -> Filled:
    """match (pairs, n, m); gap_one (pairs or 1, n, 2), gap_two (pairs or 1, m, 2): per-position open
    and extend; masked (pairs, n + 1, m + 1): cells that stay 0 in all states. ``free_local`` gives
    local alignments zero borders; without it they have those of global ones."""
    if mode not in PAIR_MODES:
        raise KernelError(f"unknown mode {mode!r}")
    pairs, n, m = match.shape
    wide, cells = m + 1, (n + 1) * (m + 1)
    high, up, left = (np.full((pairs, cells), _LOW, dtype=np.float32) for _ in range(3))
    flags = tuple(np.zeros((pairs, cells), dtype=np.uint8) for _ in range(3)) if trace else None
    high[:, 0] = 0
    local = mode == "local"
    if mode in ("semiglobal_both", "semiglobal_one") or local and free_local:
        up[:, ::wide] = 0
    elif n:
        up[:, 0] = gap_one[:, 0, 0] - gap_one[:, 0, 1]
        up[:, wide::wide] = np.arange(n) * gap_one[:, :, 1].astype(np.float64) + gap_one[:, :1, 0]
        if trace:
            flags[1][:, wide::wide] = U_MORE
    if mode in ("semiglobal_both", "semiglobal_two") or local and free_local:
        left[:, :wide] = 0
    elif m:
        left[:, 0] = gap_two[:, 0, 0] - gap_two[:, 0, 1]
        left[:, 1:wide] = np.arange(m) * gap_two[:, :, 1].astype(np.float64) + gap_two[:, :1, 0]
        if trace:
            flags[2][:, 1:wide] = L_MORE
    flat = match.reshape(pairs, n * m)
    back = gap_two[:, ::-1]
    hidden = None if masked is None else masked.reshape(-1, cells)
    for d in range(2, n + m + 1):
        top, low = max(1, d - m), min(n, d - 1)
        count = low - top + 1
        if count <= 0:
            continue
        start = top * wide + d - top

        def run(first: int, step: int = m, count: int = count) -> slice:
            return slice(first, first + step * (count - 1) + 1, max(step, 1))

        here, above, before, cross = run(start), run(start - wide), run(start - 1), run(start - wide - 1)
        s = flat[:, run((top - 1) * m + d - top - 1, m - 1)]
        o1, e1 = gap_one[:, top - 1 : low, 0], gap_one[:, top - 1 : low, 1]
        o2, e2 = back[:, m - d + top : m - d + low + 1, 0], back[:, m - d + top : m - d + low + 1, 1]
        a, b, c = high[:, cross] + s, up[:, cross] + s, left[:, cross] + s
        best = np.maximum(np.maximum(a, b), c)
        if local:
            best = np.maximum(best, np.float32(0))
        uo, ue = high[:, above] + o1, up[:, above] + e1
        lo, le = high[:, before] + o2, left[:, before] + e2
        new_up, new_left = np.maximum(uo, ue), np.maximum(lo, le)
        keep = None if hidden is None else ~hidden[:, here]
        if trace:
            f = (a == best) * np.uint8(MM) | (b == best) * np.uint8(MU) | (c == best) * np.uint8(ML)
            g = (uo == new_up) * np.uint8(U_OPEN) | (ue == new_up) * np.uint8(U_MORE)
            h = (lo == new_left) * np.uint8(L_OPEN) | (le == new_left) * np.uint8(L_MORE)
            if keep is not None:
                f, g, h = f * keep, g * keep, h * keep
            flags[0][:, here], flags[1][:, here], flags[2][:, here] = f, g, h
        if keep is not None:
            best, new_up, new_left = (np.where(keep, x, np.float32(0)) for x in (best, new_up, new_left))
        high[:, here], up[:, here], left[:, here] = best, new_up, new_left
    shape = (pairs, n + 1, wide)
    return Filled(tuple(x.reshape(shape) for x in (high, up, left)), tuple(x.reshape(shape) for x in flags) if trace else None)


def end_cell(filled: Filled, pair: int, n: int, m: int, mode: str) -> tuple[int, int, int, np.float32]:
    """(row, column, state, score) at which an alignment of sizes n and m ends."""
    states = np.stack([s[pair, : n + 1, : m + 1] for s in filled.scores], axis=-1)
    if mode == "global":
        cell = (n, m, int(np.argmax(states[n, m])))
    elif mode == "local":
        cell = tuple(int(i) for i in np.unravel_index(states.argmax(), states.shape))
    else:
        row, column = states[n], states[:, m]
        if row.max() > column.max() and mode in ("semiglobal_both", "semiglobal_two"):
            at = len(row) - 1 - int(np.argmax((row == row.max()).any(axis=1)[::-1]))
            cell = (n, at, int(np.argmax(row[at] == row.max())))
        else:
            at = len(column) - 1 - int(np.argmax((column == column.max()).any(axis=1)[::-1]))
            cell = (at, m, int(np.argmax(column[at] == column.max())))
    return (*cell, states[cell])


# Fixed order: of several best ways to a cell the first of these is taken.
_STEPS = ((MM, -1, -1, 0), (MU, -1, -1, 1), (ML, -1, -1, 2), (U_OPEN, -1, 0, 0), (U_MORE, -1, 0, 1), (L_OPEN, 0, -1, 0), (L_MORE, 0, -1, 2))


def _first_steps() -> list[tuple[int, int, int] | None]:
    return [next(((dy, dx, s) for bit, dy, dx, s in _STEPS if flag & bit), None) for flag in range(128)]


_STEP_OF = _first_steps()


def trace_back(filled: Filled, pair: int, cell: tuple[int, int, int]) -> np.ndarray:
    """The path to a cell, from where no flag leads further: rows of (consumed of one, of two)."""
    traces = [t[pair] for t in filled.traces]
    y, x, state = cell
    path = [(y, x)]
    while (step := _STEP_OF[traces[state][y, x]]) is not None:
        y, x, state = y + step[0], x + step[1], step[2]
        path.append((y, x))
    return np.array(path[::-1], dtype=np.int64)


def to_corners(path: np.ndarray, n: int, m: int) -> np.ndarray:
    """A semiglobal path led on to (0, 0) and (n, m) along the borders."""
    parts = [path]
    y, x = path[0]
    if y:
        parts.insert(0, np.stack([np.arange(y), np.zeros(y, dtype=int)], 1))
    elif x:
        parts.insert(0, np.stack([np.zeros(x, dtype=int), np.arange(x)], 1))
    y, x = path[-1]
    if y != n:
        parts.append(np.stack([np.arange(y + 1, n + 1), np.full(n - y, x)], 1))
    elif x != m:
        parts.append(np.stack([np.full(m - x, y), np.arange(x + 1, m + 1)], 1))
    return np.vstack(parts)


def spread_local(path: np.ndarray, length: int, column: int) -> np.ndarray:
    """A local path led on over all ``length`` positions of one column; -1 elsewhere."""
    def outside(values: np.ndarray) -> np.ndarray:
        out = np.full((len(values), path.shape[1]), -1)
        out[:, column] = values
        return out

    first, last = path[0, column], path[-1, column]
    return np.vstack([outside(np.arange(first)), path, outside(np.arange(last + 1, length + 1))])


def compress(path: np.ndarray, column: int) -> np.ndarray:
    """The first row and those at which a column advances."""
    return path[np.concatenate([[True], np.diff(path[:, column]) > 0])]


def align(
    match: np.ndarray, gap_one: np.ndarray, gap_two: np.ndarray, mode: str, masked: np.ndarray | None = None, free_local: bool = False
) -> tuple[float, np.ndarray]:
    """(score, path) of one pair."""
    n, m = match.shape
    hidden = None if masked is None else masked[None]
    filled = fill(match[None], gap_one[None], gap_two[None], mode, hidden, True, free_local)
    y, x, state, score = end_cell(filled, 0, n, m, mode)
    path = trace_back(filled, 0, (y, x, state))
    return float(score), to_corners(path, n, m) if mode.startswith("semiglobal") else path


def scores(matches: list[np.ndarray], gaps: tuple[float, float], mode: str, free_local: bool = False) -> list[float]:
    """Scores alone, of many pairs in one padded batch."""
    n, m = max(x.shape[0] for x in matches), max(x.shape[1] for x in matches)
    grid = np.zeros((len(matches), n, m), dtype=np.float32)
    for k, x in enumerate(matches):
        grid[k, : x.shape[0], : x.shape[1]] = x
    filled = fill(grid, gap_grid(n, gaps)[None], gap_grid(m, gaps)[None], mode, None, False, free_local)
    return [float(end_cell(filled, k, *x.shape, mode)[3]) for k, x in enumerate(matches)]


def auto_mode(n: int, m: int) -> str:
    return "semiglobal_one" if n > m else "semiglobal_two"
