"""Stacking, guide trees and multiple alignment over families.

Work that is independent per pair (stacks, distances, also within ``align_families``) runs pair by
pair over the whole cluster; what is sequential by nature (clustering, merging) runs family by family
in ``applyInPandas``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.model import TREE, Options
from symloom.operators import dp, pairwise
from symloom.operators import progressive as pg


def stacks(rows: DataFrame, matrices: list[np.ndarray], opt: Options = Options()) -> DataFrame:
    """(family_id, a, b, pass, score, path): what is stacked on each master a, over its positions."""
    if opt.preprofile_mode == "dummy":
        none = rows.filter(F.lit(False))
        return none.selectExpr("cast(family_id AS long) family_id", "ord a", "ord b", "0 pass", "cast(0 AS float) score", "cast(null AS array<array<int>>) path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for fam, a, b, one, two in zip(*(batch.column(c).to_pylist() for c in ("family_id", "a", "b", "one", "two")), strict=True):
                g = pairwise.direct_grid(one, two, matrices)
                n, m = g.shape
                gaps = dp.gap_grid(n, opt.gaps), dp.gap_grid(m, opt.gaps)
                masked = np.zeros((n + 1, m + 1), dtype=bool) if opt.preprofile_mode == "local" else None
                for k in range(opt.iterations if masked is not None else 1):
                    score, path = dp.align(g, *gaps, opt.preprofile_mode, masked, opt.strict_local)
                    if masked is not None:
                        masked[path[:, 0].min() : path[:, 0].max() + 1, path[:, 1].min() : path[:, 1].max() + 1] = True
                    if opt.score_threshold is None or score >= opt.score_threshold:
                        path = dp.compress(path, 0)
                        if masked is not None:
                            path = dp.spread_local(path, n, 0)
                        out.append((fam, a, b, k, score, path.tolist()))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float32(), pa.list_(pa.list_(pa.int32())))
            names = ["family_id", "a", "b", "pass", "score", "path"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    pairs = pairwise.ordered_pairs(rows).select(F.col("family_id").cast("long"), F.col("a").cast("int"), F.col("b").cast("int"), "one", "two")
    return pairs.repartition("family_id", "a", "b").mapInArrow(run, "family_id long, a int, b int, pass int, score float, path array<array<int>>")


def preprofiles(rows: DataFrame, matrices: list[np.ndarray], opt: Options = Options()) -> DataFrame:
    """(family_id, ord, pos, sym, cnt): counts of each master's stack, the master included. Counting is
    native: a stacked path emits a residue wherever its second side advances."""
    first = F.col("sets")[0]
    own = rows.select(F.col("family_id").cast("long").alias("family_id"), "ord", F.posexplode(first).alias("pos", "sym"))
    done = stacks(rows, matrices, opt)
    pairs = F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("here"), F.slice("path", F.lit(2), F.size("path") - 1).alias("next"))
    moves = done.filter(F.size("path") > 1).select("family_id", F.col("a").alias("ord"), "b", F.posexplode(pairs).alias("pos", "s"))
    grown = F.col("s.next")[1] > F.col("s.here")[1]
    moves = moves.filter(grown if opt.spill_over else grown & (F.col("s.here")[1] >= 0))
    moves = moves.select("family_id", "ord", "b", "pos", (F.col("s.next")[1] - 1).alias("at"))
    other = rows.select(F.col("family_id").cast("long").alias("family_id"), F.col("ord").alias("b"), F.posexplode(first).alias("at", "sym"))
    stacked = moves.join(other, ["family_id", "b", "at"]).select("family_id", "ord", "pos", "sym")
    return own.unionByName(stacked).groupBy("family_id", "ord", "pos", "sym").agg(F.count("*").alias("cnt"))


def distances(rows: DataFrame, matrices: list[np.ndarray], opt: Options = Options()) -> DataFrame:
    """(family_id, a, b, score, distance): the family's highest score, at least 0, minus the pair's."""
    mode = {"global": "global", "semiglobal": "semiglobal_both", "semiglobal_auto": "auto"}[opt.dist_mode]
    return _from_best(pairwise.align_pairs(pairwise.unordered_pairs(rows), matrices, opt, mode))


def _from_best(scores: DataFrame) -> DataFrame:
    """A window, not a join with the aggregate, which would align all pairs twice; guide trees group by
    the same key afterwards."""
    most = F.greatest(F.max("score").over(Window.partitionBy("family_id")), F.lit(0.0).cast("float"))
    return scores.select("family_id", "a", "b", "score", (most - F.col("score")).alias("distance"))


def profiled(rows: DataFrame, matrices: list[np.ndarray], opt: Options = Options()) -> DataFrame:
    """(family_id, ord, sets, at, sym, cnt): members, with the counts of their stacks as arrays."""
    held = preprofiles(rows, matrices, opt).groupBy("family_id", "ord").agg(F.collect_list(F.struct("pos", "sym", "cnt")).alias("held"))
    mine = rows.select(F.col("family_id").cast("long").alias("family_id"), F.col("ord").cast("int").alias("ord"), "sets")
    parts = [F.col("held.pos").alias("at"), F.col("held.sym").alias("sym"), F.col("held.cnt").alias("cnt")]
    return mine.join(held, ["family_id", "ord"], "left").select("family_id", "ord", "sets", *parts)


def _member(row: dict, sizes: list[int]) -> pg.Member:
    """One row of ``profiled``; a sequence without positions has no counts."""
    plain = pg.member([np.asarray(s, dtype=np.int64) for s in row["sets"]], sizes)
    counts = np.zeros_like(plain.counts[0])
    if len(plain):
        counts[np.asarray(row["at"]), np.asarray(row["sym"])] = row["cnt"]
    return pg.Member(plain.symbols, [counts, *plain.counts[1:]])


def profile_distances(members: DataFrame, matrices: list[np.ndarray], opt: Options = Options()) -> DataFrame:
    """As ``distances``, of members as ``profiled`` gives them: profile against profile."""
    sizes = [m.shape[0] for m in matrices]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = ([_member(v, sizes) for v in batch.column(c).to_pylist()] for c in ("one", "two"))
            grids = [pg.grid(p.counts, q.counts, matrices) for p, q in zip(one, two, strict=True)]
            score = pairwise.batched_scores(grids, [pg.pair_mode(opt.dist_mode, *g.shape) for g in grids], opt)
            cols = [batch.column(c) for c in ("family_id", "a", "b")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(score, pa.float32())], names=["family_id", "a", "b", "score"])

    pairs = pairwise.unordered_pairs(members.select("family_id", "ord", F.struct("sets", "at", "sym", "cnt").alias("sets")))
    return _from_best(pairs.repartition("family_id", "a", "b").mapInArrow(run, "family_id long, a int, b int, score float"))


def _square(ids: np.ndarray, pdf: pd.DataFrame) -> np.ndarray:
    """Distances of a family's pairs as a matrix in the order of ``ids``."""
    i, j = np.searchsorted(ids, pdf["a"]), np.searchsorted(ids, pdf["b"])
    d = np.zeros((len(ids), len(ids)))
    d[i, j] = d[j, i] = pdf["distance"]
    return d


def guide_trees(distance: DataFrame, opt: Options = Options()) -> DataFrame:
    """(family_id, step, left, right): merges in order, right into left."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([pdf["a"], pdf["b"]]))
        order = pg.merge_order(_square(ids, pdf), opt.linkage)
        return pd.DataFrame([(key[0], k, int(ids[x]), int(ids[y])) for k, (x, y) in enumerate(order)], columns=["family_id", "step", "left", "right"])

    return distance.groupBy("family_id").applyInPandas(run, TREE)


def align_families(rows: DataFrame, matrices: list[np.ndarray], opt: Options = Options()) -> DataFrame:
    """(family_id, items, path) of every family: stack, then join along a tree or greedily. Stacks and
    the scores of all pairs come from the whole cluster; a family's task only orders and joins."""
    sizes = [m.shape[0] for m in matrices]
    members = profiled(rows, matrices, opt)

    def run(key: tuple, pdf: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        ids, ready = pdf["ord"].to_numpy(), [_member(row, sizes) for row in pdf.to_dict("records")]
        if opt.msa_mode == "tree":
            done = pg.along_tree(ready, pg.merge_order(_square(ids, pairs), opt.linkage), matrices, opt)
        else:
            at = zip(np.searchsorted(ids, pairs["a"]).tolist(), np.searchsorted(ids, pairs["b"]).tolist(), strict=True)
            done = pg.greedy(ready, matrices, opt, dict(zip(at, pairs["score"].tolist(), strict=True)))
        return pd.DataFrame({"family_id": [key[0]], "items": [[int(ids[k]) for k in done.items]], "path": [done.path.tolist()]})

    sides = members.groupBy("family_id"), profile_distances(members, matrices, opt).groupBy("family_id")
    return sides[0].cogroup(sides[1]).applyInPandas(run, "family_id long, items array<int>, path array<array<int>>")


def gapped_rows(alignments: DataFrame, texts: DataFrame, gap: str = "-") -> DataFrame:
    """(family_id, ord, place, gapped): each member's row, from (family_id, ord, text)."""
    rows = alignments.select("family_id", "path", F.posexplode("items").alias("place", "ord")).join(texts, ["family_id", "ord"])
    mine = F.transform("path", lambda r: F.get(r, F.col("place")))
    shown = F.transform(
        F.sequence(F.lit(1), F.size("path") - 1),
        lambda k: F.when(F.get(F.col("mine"), k) > F.get(F.col("mine"), k - 1), F.substring(F.col("text"), F.get(F.col("mine"), k), F.lit(1))).otherwise(gap),
    )
    rows = rows.withColumn("mine", mine)
    return rows.select("family_id", "ord", "place", F.when(F.size("path") > 1, F.array_join(shown, "")).otherwise("").alias("gapped"))
