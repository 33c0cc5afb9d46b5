"""Pairs of sequences within families, and their alignment in Arrow batches.

``rows`` hold (family_id, ord, sets): one array of symbol indices per track set. Pairs come from an
equi-join on the family with an order condition; the kernel gets them dealt evenly by pair, since a
pair costs the product of its lengths whatever family it is from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.model import KernelError, Options, check_columns
from symloom.operators import dp
from symloom.operators.registry import resolve_aligner

#: Cells of one padded batch.
CELLS = 1 << 21


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    check_columns(rows, "family_id", "ord", "sets")
    one = rows.select("family_id", F.col("ord").alias("a"), F.col("sets").alias("one"))
    return one, rows.select("family_id", F.col("ord").alias("b"), F.col("sets").alias("two"))


def unordered_pairs(rows: DataFrame) -> DataFrame:
    """Every pair once, a < b."""
    one, two = _sides(rows)
    return one.join(two, "family_id").filter("a < b")


def ordered_pairs(rows: DataFrame) -> DataFrame:
    """Every master a with every other b."""
    one, two = _sides(rows)
    return one.join(two, "family_id").filter("a <> b")


def auto_mode(one: Column, two: Column) -> Column:
    """The longer side may hang over."""
    return F.when(F.size(one) > F.size(two), "semiglobal_one").otherwise("semiglobal_two")


def direct_grid(one: list, two: list, matrices: list[np.ndarray]) -> np.ndarray:
    """Match scores of plain tracks, by lookup."""
    if not len(one) == len(two) == len(matrices):
        raise KernelError("as many track sets as score matrices are needed on both sides")
    out = np.zeros((len(one[0]), len(two[0])), dtype=np.float32)
    for p, q, s in zip(one, two, matrices, strict=True):
        out += s[np.asarray(p, dtype=np.int64)][:, np.asarray(q, dtype=np.int64)]
    return out


def _batched(grids: list[np.ndarray], gaps: tuple[float, float], mode: str, free_local: bool) -> list[float]:
    """Scores of grids of any shapes: like shapes together, in padded batches of bounded size."""
    order = sorted(range(len(grids)), key=lambda k: grids[k].shape)
    out, some, high, wide = [0.0] * len(grids), [], 0, 0
    for k in [*order, None]:
        if k is not None:
            n, m = max(high, grids[k].shape[0]), max(wide, grids[k].shape[1])
        if some and (k is None or (n + 1) * (m + 1) * (len(some) + 1) > CELLS):
            for i, s in zip(some, dp.scores([grids[i] for i in some], gaps, mode, free_local), strict=True):
                out[i] = s
            some = []
            if k is not None:
                n, m = grids[k].shape
        if k is not None:
            some.append(k)
            high, wide = n, m
    return out


def batched_scores(grids: list[np.ndarray], modes: list[str], opt: Options) -> list[float]:
    """Scores of grids, each aligned in its own mode."""
    out = [0.0] * len(grids)
    for m in set(modes):
        at = [k for k, x in enumerate(modes) if x == m]
        for k, s in zip(at, _batched([grids[k] for k in at], opt.gaps, m, opt.strict_local), strict=True):
            out[k] = s
    return out


def align_pairs(pairs: DataFrame, matrices: list[np.ndarray], opt: Options = Options(), mode: str = "global", with_path: bool = False) -> DataFrame:
    """(family_id, a, b, score[, path]) of pairs (family_id, a, b, one, two); mode "auto" picks by
    length. Without paths no traceback is made at all."""
    custom = resolve_aligner(opt.aligner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column("one").to_pylist(), batch.column("two").to_pylist()
            grids = [direct_grid(p, q, matrices) for p, q in zip(one, two, strict=True)]
            modes = [dp.auto_mode(*g.shape) if mode == "auto" else mode for g in grids]
            cols = [batch.column(c) for c in ("family_id", "a", "b")]
            if with_path or custom:
                align = custom or dp.align
                done = [
                    align(g, dp.gap_grid(g.shape[0], opt.gaps), dp.gap_grid(g.shape[1], opt.gaps), m, None, opt.strict_local)
                    for g, m in zip(grids, modes, strict=True)
                ]
                score = [s for s, _ in done]
            else:
                score = batched_scores(grids, modes, opt)
            cols.append(pa.array(score, pa.float32()))
            if with_path:
                cols.append(pa.array([p.tolist() for _, p in done], pa.list_(pa.list_(pa.int32()))))
            yield pa.RecordBatch.from_arrays(cols, names=["family_id", "a", "b", "score", "path"][: len(cols)])

    dealt = pairs.select(F.col("family_id").cast("long"), F.col("a").cast("int"), F.col("b").cast("int"), "one", "two")
    dealt = dealt.repartition("family_id", "a", "b")
    return dealt.mapInArrow(run, "family_id long, a int, b int, score float" + (", path array<array<int>>" if with_path else ""))


def match_grid(pairs: DataFrame, matrix: DataFrame) -> DataFrame:
    """(family_id, a, b, y, x, score) of symbol-array pairs, by joins: the relational form of the
    kernel's grid. ``pairs``: one and two as arrays of symbols; ``matrix``: (sym_a, sym_b, score)."""
    cells = pairs.select("family_id", "a", "b", F.posexplode("one").alias("y", "sym_a"), "two")
    cells = cells.select("family_id", "a", "b", "y", "sym_a", F.posexplode("two").alias("x", "sym_b"))
    return cells.join(matrix, ["sym_a", "sym_b"], "left").select("family_id", "a", "b", "y", "x", F.coalesce("score", F.lit(0.0)).alias("score"))
