"""Profiles and alignment algebra as joins, windows and aggregations over long tables.

Long paths are (keys, item, row, consumed): residues of an item consumed at a path row. Long symbols
are (keys, item, pos, sym). Counts are (keys, pos, sym, cnt)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def long_paths(alignments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """From (keys, path array<array<int>>) to one row per path row and item."""
    rows = alignments.select(*keys, F.posexplode("path").alias("row", "step"))
    return rows.select(*keys, "row", F.posexplode("step").alias("item", "consumed"))


def steps(paths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, item, col, pos): the residue an item emits in each column; gaps give no row."""
    before = F.lag("consumed").over(Window.partitionBy(*keys, "item").orderBy("row"))
    rows = paths.withColumn("before", before).filter("consumed > before")
    return rows.select(*keys, "item", (F.col("row") - 1).alias("col"), (F.col("consumed") - 1).alias("pos"))


def compress(paths: DataFrame, keys: Sequence[str], item: int) -> DataFrame:
    """Of every path its first row and those at which one item advances."""
    mine = paths.filter(F.col("item") == item)
    before = F.lag("consumed").over(Window.partitionBy(*keys).orderBy("row"))
    kept = mine.withColumn("before", before).filter("before IS NULL OR consumed > before").select(*keys, "row")
    return paths.join(kept, [*keys, "row"], "left_semi")


def frequencies(emitted: DataFrame, symbols: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pos, sym, cnt): symbol counts per column, from ``steps`` and long symbols."""
    rows = emitted.join(symbols, [*keys, "item", "pos"])
    return rows.groupBy(*keys, F.col("col").alias("pos"), "sym").agg(F.count("*").alias("cnt"))


def one_hot(symbols: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pos, sym, cnt): a plain track as a profile, one count per position."""
    return symbols.select(*keys, "pos", "sym", F.lit(1).cast("long").alias("cnt"))


def lookup(pairs: DataFrame, matrix: DataFrame) -> DataFrame:
    """Rows with ``score``, the matrix entry of (sym_a, sym_b); pairs that it lacks score 0. The
    matrix has one row per pair of an alphabet's symbols and is broadcast."""
    return pairs.join(F.broadcast(matrix), ["sym_a", "sym_b"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def probabilities(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    total = F.sum("cnt").over(Window.partitionBy(*keys, "pos"))
    return counts.withColumn("share", F.col("cnt") / total)


def consensus(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pos, sym, cnt): the most frequent symbol, the least one of equals; a partial
    aggregation, no sort."""
    best = F.max(F.struct("cnt", (-F.col("sym")).alias("order"))).alias("best")
    rows = counts.groupBy(*keys, "pos").agg(best)
    return rows.select(*keys, "pos", (-F.col("best.order")).alias("sym"), F.col("best.cnt").alias("cnt"))


def merge_counts(one: DataFrame, two: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of two profiles over the same columns."""
    return one.unionByName(two).groupBy(*keys, "pos", "sym").agg(F.sum("cnt").alias("cnt"))


def merge_paths(guide: DataFrame, path: DataFrame, keys: Sequence[str], side: int) -> DataFrame:
    """Rows of a path that one side of a guide path asks for; -1 stays -1."""
    wanted = guide.filter(F.col("item") == side).select(*keys, F.col("row").alias("new"), F.col("consumed").alias("row"))
    inside = wanted.join(path, [*keys, "row"]).select(*keys, F.col("new").alias("row"), "item", "consumed")
    items = path.select(*keys, "item").distinct()
    outside = wanted.filter("row < 0").join(items, list(keys)).select(*keys, F.col("new").alias("row"), "item", F.lit(-1).alias("consumed"))
    return inside.unionByName(outside)


def expected_scores(counts: DataFrame, matrix: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pos, sym_a, expected): mean score of each symbol against a position's counts."""
    total = counts.groupBy(*keys, "pos").agg(F.sum("cnt").alias("total"))
    rows = counts.join(F.broadcast(matrix), counts["sym"] == matrix["sym_b"])
    rows = rows.groupBy(*keys, "pos", "sym_a").agg(F.sum(F.col("cnt") * F.col("score")).alias("sum"))
    return rows.join(total, [*keys, "pos"]).select(*keys, "pos", "sym_a", (F.col("sum") / F.col("total")).alias("expected"))


def conservation(columns: DataFrame, matrix: DataFrame, keys: Sequence[str], items: int) -> DataFrame:
    """(keys, pos, mark) from symbol counts without gaps: all ordered pairs of a column, gaps scoring
    0, against the best self score times all pairs; '*' from 0.9, ':' from 0.4. Pairs come from
    counts, so a column costs its distinct symbols squared, not its items."""
    one, two = columns.select(*keys, "pos", F.col("sym").alias("sym_a"), F.col("cnt").alias("n")), columns.select(
        *keys, "pos", F.col("sym").alias("sym_b"), F.col("cnt").alias("m")
    )
    rows = one.join(two, [*keys, "pos"]).join(F.broadcast(matrix), ["sym_a", "sym_b"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    rows = rows.groupBy(*keys, "pos").agg(
        F.sum(F.col("n") * F.col("m") * F.col("score")).alias("total"), F.max(F.when(F.col("sym_a") == F.col("sym_b"), F.col("score"))).alias("best")
    )
    most = F.col("best") * float(items * items)
    mark = F.when(F.col("total") >= 0.9 * most, "*").when(F.col("total") >= 0.4 * most, ":").otherwise(" ")
    return rows.select(*keys, "pos", mark.alias("mark"))
