import itertools

import numpy as np
import pytest

from symloom.model import KernelError
from symloom.operators import dp


def plain(match, gaps, mode):
    """Cell by cell, in Python floats."""
    n, m = match.shape
    low = float("-inf")
    o = np.full((n + 1, m + 1, 3), low)
    o[0, 0, 0] = 0
    go, ge = gaps
    o[:, 0, 1] = 0 if mode in ("semiglobal_both", "semiglobal_one") else [go - ge + k * ge for k in range(n + 1)]
    o[0, :, 2] = 0 if mode in ("semiglobal_both", "semiglobal_two") else [go - ge + k * ge for k in range(m + 1)]
    for y, x in itertools.product(range(1, n + 1), range(1, m + 1)):
        best = max(o[y - 1, x - 1]) + match[y - 1, x - 1]
        o[y, x, 0] = max(best, 0) if mode == "local" else best
        o[y, x, 1] = max(o[y - 1, x, 0] + go, o[y - 1, x, 1] + ge)
        o[y, x, 2] = max(o[y, x - 1, 0] + go, o[y, x - 1, 2] + ge)
    if mode == "global":
        return o[n, m].max()
    if mode == "local":
        return o.max()
    row, col = o[n].max(), o[:, m].max()
    return row if row > col and mode != "semiglobal_one" else col


@pytest.mark.parametrize("mode", ["global", "local", "semiglobal_both", "semiglobal_one", "semiglobal_two"])
@pytest.mark.parametrize("gaps", [(-3.0, -1.0), (-2.0, -2.0)])
def test_scores_and_paths(mode, gaps):
    rng = np.random.default_rng(4)
    grids = [rng.integers(-3, 4, (rng.integers(1, 8), rng.integers(1, 8))).astype(np.float32) for _ in range(60)]
    assert dp.scores(grids, gaps, mode) == [plain(g, gaps, mode) for g in grids]
    for g in grids:
        n, m = g.shape
        score, path = dp.align(g, dp.gap_grid(n, gaps), dp.gap_grid(m, gaps), mode)
        assert score == plain(g, gaps, mode)
        step = np.diff(path, axis=0)
        assert ((step == 0) | (step == 1)).all() and (step.sum(1) > 0).all()
        if mode != "local":
            assert tuple(path[0]) == (0, 0) and tuple(path[-1]) == (n, m)


def test_masked_cells_stay_zero():
    g = np.ones((4, 4), np.float32)
    masked = np.zeros((5, 5), bool)
    masked[1:, 1:] = True
    score, path = dp.align(g, dp.gap_grid(4, (-2, -1)), dp.gap_grid(4, (-2, -1)), "local", masked)
    assert score == 0 and len(path) == 1


def test_gap_positions_and_errors():
    g = np.zeros((3, 1), np.float32)
    one = np.array([[-5, -1], [-1, -1], [-5, -1]], np.float32)
    score, path = dp.align(g, one, dp.gap_grid(1, (-9, -9)), "global")
    assert path[-1].tolist() == [3, 1] and score > -9
    with pytest.raises(KernelError):
        dp.align(g, one, one, "sideways")


def test_path_tools():
    p = np.array([[1, 2], [2, 3], [2, 4], [3, 5]])
    assert dp.compress(p, 0).tolist() == [[1, 2], [2, 3], [3, 5]]
    assert dp.spread_local(p, 5, 0).tolist() == [[0, -1], [1, 2], [2, 3], [2, 4], [3, 5], [4, -1], [5, -1]]
    assert dp.to_corners(np.array([[0, 2], [1, 3]]), 3, 3).tolist() == [[0, 0], [0, 1], [0, 2], [1, 3], [2, 3], [3, 3]]
    assert dp.auto_mode(3, 2) == "semiglobal_one" and dp.auto_mode(2, 2) == "semiglobal_two"
