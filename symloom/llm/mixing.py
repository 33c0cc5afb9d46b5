"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each document gets the rate r = min(most, exp(lambda * size / scale)) of its source: of all rates
in [0, most], those closest to 1 in relative entropy whose expected words meet the source's target.
The convex dual has one multiplier per source; safeguarded Newton steps (a bisection where a step
leaves its bracket) run for all sources at once over the counts of each (source, size), which a
partial aggregation makes before the only wide shuffle. Its sums are decimals, so no order of adding changes them. Rates become whole copies: running sums of
the expected copies are rounded per size, a short walk over a source's sizes from large to small
removes the words still missing or left over, and the documents of one size share its copies by
their hash rank, taken in salted sub-groups. Nothing depends on the session's number of partitions.

Defined results: null and empty texts have size 0 and are never taken; a null source is a source of
its own, last in order; a source without words has target 0; repeated rows are documents of their
own; an empty table gives an empty table; other columns do not matter to ``mix`` and are carried whole,
inside one struct, by ``repeat_documents``, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.llm.common import WORD, materialize, table

WEIGHTS = (5, 2, 1)
MOST = 3
#: Newton stops when no source is off its target by more than this share, or after so many steps.
TOLERANCE, STEPS = 1e-9, 40
#: Bounds of a multiplier: rates from e**-40 (none) up, sizes being scaled to 1 on average.
REACH = 40.0
#: Summed in any order, these give the same.
EXACT = "decimal(28, 6)"
#: Sub-groups of the documents of one source and size: a fixed number, as it decides who takes odd copies.
SALTS = 1_024


def words(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(cells: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(no_source, source, source_size, target): weights repeat by code point order, and what a
    source's limit of ``most`` times its size cuts off goes to the others by weight.

    Resharing until no target is above its limit ends at min(limit, level * weight) with one level
    for all: with limits per weight in ascending order, the first k sources are at their limits,
    where k is the number whose limit per weight is below the level the rest would then get. The
    windows run over one row per source."""
    source = cells.groupBy("no_source", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    order = Window.orderBy("no_source", "source")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    source = source.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), "no_source", "source").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    source = (
        source.withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("limit").over(before), zero))
        .withColumn("own", F.col("left") / F.col("rest"))
        .withColumn("free", F.col("limit") / F.col("weight") >= F.col("own"))
    )
    level = F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("weight"), F.col("own")))).over(whole)
    return source.withColumn("level", F.coalesce(level["own"], zero)).select(
        "no_source",
        "source",
        F.col("source_size").cast("long").alias("source_size"),
        F.least(F.col("limit"), F.col("level") * F.col("weight")).alias("target"),
    )


KEY = ["no_source", "source"]


def rates(cells: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """The cells with their ``rate`` by Newton's method on the dual, one small job per step."""
    cells = cells.filter("size > 0")
    scale = cells.groupBy(*KEY).agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("scale"))
    state = goals.join(scale, KEY).select(
        *KEY, "source_size", "target", "scale", F.lit(0.0).alias("dual"), F.lit(-REACH).alias("low"), F.lit(REACH).alias("high"), (F.col("target") >= F.col("source_size") * float(most)).alias("done")
    )
    state = materialize(state.coalesce(1), "mix-state")
    hint = F.broadcast if state.limit(SMALL + 1).count() <= SMALL else (lambda df: df)
    x, rate = F.col("size") / F.col("scale"), F.least(F.lit(float(most)), F.exp(F.col("dual") * F.col("size") / F.col("scale")))
    for _ in range(STEPS):
        at = (
            cells.join(hint(state), KEY)
            .groupBy(*KEY, "source_size", "target", "scale", "dual", "low", "high", "done")
            .agg(
                F.sum((F.col("n") * F.col("size") * rate).cast(EXACT)).cast("double").alias("value"),
                F.sum(F.when(rate < float(most), F.col("n") * F.col("size") * rate * x).otherwise(0.0).cast(EXACT)).cast("double").alias("slope"),
            )
        )
        off = F.col("value") - F.col("target")
        at = at.withColumn("done", F.col("done") | (F.abs(off) <= TOLERANCE * F.col("target")) | (F.col("high") - F.col("low") < 1e-12))
        at = at.withColumn("low", F.when(off < 0, F.col("dual")).otherwise(F.col("low"))).withColumn("high", F.when(off > 0, F.col("dual")).otherwise(F.col("high")))
        step = F.col("dual") - off / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (step > F.col("low")) & (step < F.col("high"))
        at = at.withColumn("dual", F.when(F.col("done"), F.col("dual")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2))
        state = materialize(at.select(*state.columns).coalesce(1), "mix-state")
        if not state.filter(~F.col("done")).limit(1).count():
            break
    # at its limit a source's multiplier has no finite value: every rate is the limit itself
    full = F.col("target") >= F.col("source_size") * float(most)
    return cells.join(hint(state), KEY).withColumn("rate", F.when(full, F.lit(float(most))).otherwise(rate))


#: A state of at most so many sources is broadcast to the cells (some 100 bytes each).
SMALL = 50_000


def copies(cells: DataFrame, most: int = MOST) -> DataFrame:
    """Whole ``copies`` per cell, 0 to ``most`` per document, from the cells' rates.

    The running expected copies are rounded, sizes from large to small; then a walk over the
    source's distinct sizes (never its documents) takes or gives what whole documents can."""
    run = Window.partitionBy(*KEY).orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.floor(F.sum(F.col("n") * F.col("rate")).over(run) + 0.5)
    cells = cells.withColumn("upto", upto)
    last = Window.partitionBy(*KEY).orderBy(F.desc("size"))
    cells = cells.withColumn("c", F.col("upto") - F.coalesce(F.lag("upto").over(last), F.lit(0)))
    cells = cells.withColumn("c", F.greatest(F.lit(0), F.least(F.col("c"), most * F.col("n"))).cast("long"))
    walk = cells.groupBy(*KEY, "target").agg(
        F.round(F.first("target") - F.sum(F.col("c") * F.col("size"))).cast("long").alias("off"),
        F.sort_array(F.collect_list(F.struct("size", "n", "c")), asc=False).alias("sizes"),
    )
    change = F.aggregate(
        "sizes",
        F.struct(F.col("off").alias("off"), F.array().cast("array<struct<size:bigint,d:bigint>>").alias("changes")),
        _walk(most),
        lambda acc: acc["changes"],
    )
    moved = walk.select(*KEY, F.explode(change).alias("m")).select(*KEY, F.col("m.size").alias("size"), F.col("m.d").alias("d"))
    return cells.join(moved, [*KEY, "size"], "left").select(
        *KEY, "source_size", "target", "size", "n", "rate", (F.col("c") + F.coalesce(F.col("d"), F.lit(0))).alias("copies")
    )


def _walk(most: int):
    def step(acc: Column, x: Column) -> Column:
        need = F.floor(F.abs(acc["off"]) / x["size"]).cast("long")
        room = F.when(acc["off"] > 0, most * x["n"] - x["c"]).otherwise(x["c"])
        d = F.signum(acc["off"]).cast("long") * F.least(need, room)
        return F.struct(
            (acc["off"] - d * x["size"]).alias("off"),
            F.when(d != 0, F.concat(acc["changes"], F.array(F.struct(x["size"].alias("size"), d.alias("d"))))).otherwise(acc["changes"]).alias("changes"),
        )

    return step


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, rows: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies) for every document; with ``rows``
    also the whole input row as struct ``row``."""
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if rows else []
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").isNull().alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        words().alias("size"),
        F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]).alias("tie"),
        *carried,
    )
    base = materialize(base.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(SALTS))), "mix-sizes")
    salted = base.groupBy(*KEY, "size", "salt").agg(F.count("*").alias("k"))
    cells = materialize(salted.groupBy(*KEY, "size").agg(F.sum("k").alias("n")), "mix-cells")
    goals = targets(cells, weights, most)
    given = copies(rates(cells, goals, most), most)
    empty = cells.filter("size = 0").join(goals, KEY).select(
        *KEY, "source_size", "target", "size", "n", F.lit(1.0).alias("rate"), F.lit(0).cast("long").alias("copies")
    )
    given = materialize(given.unionByName(empty), "mix-copies")
    # rank of a document within its (source, size): offset of its salted sub-group, then its place there
    before = Window.partitionBy(*KEY, "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    place = salted.withColumn("base", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k").join(given, [*KEY, "size"])
    within = Window.partitionBy(*KEY, "size", "salt").orderBy("doc_id", "tie")
    out = base.join(place, [*KEY, "size", "salt"]).withColumn("rank", F.col("base") + F.row_number().over(within) - 1)
    whole = F.floor(F.col("copies") / F.col("n")).cast("long")
    mine = whole + F.when(F.col("rank") < F.col("copies") - whole * F.col("n"), 1).otherwise(0)
    return out.select(
        "doc_id",
        F.when(~F.col("no_source"), F.col("source")).alias("source"),
        "size",
        "source_size",
        "target",
        "rate",
        mine.cast("long").alias("copies"),
        *(["row"] if rows else []),
    )


def repeat_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: every document as often as it has copies, all columns kept."""
    out = mix(docs, weights, most, rows=True).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")
