"""Line dedup by a segment-partition edit join, in DataFrame operations only.

A line goes if an equal line stands before it in (doc_id, text hash, line) order, or if a line whose
first occurrence is earlier is within ``EDITS`` edits. A line is cut into EDITS + 1 segments, and of two
lines within EDITS edits there is a segment i of either that the other has too, with i edits before it
and EDITS - i at most behind it: counted from the nearer end, the smaller of these numbers bounds by how
many places it is shifted, up to r. Lines meet under (kind of length, segment, text of a window), with
r + 1 windows a segment, each r shorter than it and starting one place after the other: a shift by up to
r brings a window of one line onto one of the other. Two edits make four windows: one in the first
segment, two in the second, one in the third. Candidates are verified by a banded bit-parallel edit
distance: one bit per diagonal of the band, one word per number of edits, one step per character of what
is left without equal ends.

What meets under a key is never paired as a whole. The lines of a small bucket are paired; those of a
larger one first meet the bucket's earliest line only, which settles families of lines that are all
alike (one earlier near line is enough). What is still unsettled is dealt again by its characters: two
edits change the counts of characters by four in all, so of five classes of characters one holds as many
in both lines (of eight classes four and of twelve eight, in ever larger buckets), and lines only meet
that agree on the counts of such classes. Pairs whose counts differ by more than four in all are let go
where they meet. A pair meets once, of all the buckets that share it in the smallest and of all classes
in the first.

Edits are counted in code points. Lines shorter than ``least`` are left out of the edit join; equal
lines go from ``exact`` characters on, which is ``least`` unless a caller says less: the query and its
SQL leave lines under ``LEAST`` alone, the pipeline passes 1, so every repeated non-empty line goes.

Defined results: null text has one empty line, which is kept, as every empty line is; rows with the
same doc_id and text are one document: their lines go or stay alike; a document keeps its row even
if all its lines go, unless ``emptied`` asks ``dedup_lines`` to drop documents left without a word; an
empty table gives an empty table; ``dedup_lines`` carries the other columns whole, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.common import WORD, materialize, table

EDITS, LEAST = 2, 24
#: Buckets of at most so many entries pair all of them; from so many on, more classes are used.
SMALL, LARGE = 8, (512, 65_536)
#: Classes of characters, and the finer ones that they are made of.
COARSE, CLASSES = (5, 8, 12), 24
#: So many lengths are of one kind, and cut alike.
WIDE = 8
#: Equal ends go down to the length divided by two to this power.
HALVINGS = 6
#: Line names are broadcast up to so many (16 bytes each), and joined by a shuffle beyond.
FEW = 1_000_000
#: A line is frequent from this share of all repeated lines on: there are at most so many of them.
FREQUENT = 10_000


def _windows(edits: int) -> list[tuple[int, int, int, int, int]]:
    """(segment, whole lengths and parts of one from the line's start, shift, slack) of every window: a segment
    is placed from its nearer end, and a window is shorter than it by the slack."""
    out = []
    for i in range(edits + 1):
        slack = min(i, edits - i)
        whole, parts = (0, i) if i <= edits - i else (1, i - edits - 1)
        out += [(i, whole, parts, shift, slack) for shift in range(slack + 1)]
    return out


def entries(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(key, h1) of every line: hashed (kind of length, segment, window). Lengths of one kind are cut alike;
    the first lengths of a kind are also cut like the kind before, so lines of near lengths share one."""
    wide = max(WIDE, edits + 1)
    names = ("less", "i", "whole", "parts", "shift", "slack")
    spots = [(less, *window) for less in (0, 1) for window in _windows(edits)]
    spots = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, spot, strict=True)]) for spot in spots])
    plain = (F.octet_length("line") == F.col("size")).alias("plain")
    rows = lines.select("h1", "size", "line", F.col("line").cast("binary").alias("raw"), plain, F.explode(spots).alias("at"))
    rows = rows.filter((F.col("at.less") == 0) | (F.col("size") % wide < edits) & (F.col("size") >= wide))
    kind = F.floor(F.col("size") / wide).cast("int") - F.col("at.less")
    rows = rows.withColumn("kind", kind).withColumn("part", F.floor(F.col("kind") * wide / (edits + 1)).cast("int"))
    start = F.col("at.whole") * F.col("size") + F.col("at.parts") * F.col("part") + F.col("at.shift") + 1
    n = F.greatest(F.col("part") - F.col("at.slack"), F.lit(0))
    # of a line of one-byte characters the bytes are cut, without counting characters
    text = F.when(F.col("plain"), F.substring("raw", start, n)).otherwise(F.substring("line", start, n).cast("binary"))
    return rows.select(F.xxhash64("kind", "at.i", text).alias("key"), "h1")


def _cores(a: Column, b: Column) -> Column:
    """Both texts as (a, b) without most of what they share at their ends, which no edit distance depends on:
    halves, quarters and so on of what ``a`` has go where they are equal."""
    sizes = F.array(*[F.greatest(F.lit(1), F.shiftright(F.length(a), k)) for k in range(1, HALVINGS + 1)])
    both = lambda x, y: F.struct(x.alias("a"), y.alias("b"))

    def head(acc: Column, n: Column) -> Column:
        same = F.left(acc["a"], n) == F.left(acc["b"], n)
        return F.when(same, both(F.substr(acc["a"], n + 1), F.substr(acc["b"], n + 1))).otherwise(acc)

    def tail(acc: Column, n: Column) -> Column:
        same = F.right(acc["a"], n) == F.right(acc["b"], n)
        return F.when(same, both(*[F.left(acc[s], F.length(acc[s]) - n) for s in "ab"])).otherwise(acc)

    return F.aggregate(sizes, F.aggregate(sizes, both(a, b), head), tail)


def _within(a: Column, b: Column, edits: int) -> Column:
    """Whether two texts are within ``edits`` edits of each other.

    Word d holds a bit per diagonal (places in ``a`` minus places in ``b``, -edits to edits) on which
    d edits at most reach this far: kept by a match, and by one edit more shifted down (a character
    of ``b`` is extra), in place (replaced) or up (a character of ``a`` is extra). The characters of
    ``a`` ride along in the state: outside of it they would be cut anew at every step. The matches of a
    step are bound to a name, as an expression is worked out wherever it stands."""
    width = 2 * edits + 1
    full = (1 << width) - 1
    names = [f"r{d}" for d in range(edits + 1)]
    # empty texts before the characters of a: they match nothing
    chars = F.concat(F.array_repeat(F.lit(""), edits), F.split(a, ""))
    start = F.struct(F.lit(0).alias("j"), chars.alias("chars"), *[F.lit(((1 << d + 1) - 1) << edits & full).alias(names[d]) for d in range(edits + 1)])

    def step(acc: Column, c: Column) -> Column:
        hit = None
        for k in range(width):
            bit = F.when(F.get(acc["chars"], acc["j"] + k) == c, F.lit(1 << k)).otherwise(F.lit(0))
            hit = bit if hit is None else hit.bitwiseOR(bit)

        def moved(hit: Column) -> Column:
            after = [acc[names[0]].bitwiseAND(hit)]
            for d in range(1, edits + 1):
                less = acc[names[d - 1]]
                more = less.bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(after[d - 1], 1))
                after.append(acc[names[d]].bitwiseAND(hit).bitwiseOR(more).bitwiseAND(F.lit(full)))
            return F.struct((acc["j"] + 1).alias("j"), acc["chars"].alias("chars"), *[w.alias(n) for w, n in zip(after, names, strict=True)])

        dead = acc[names[-1]] == 0  # no diagonal is left: nothing can follow
        return F.when(dead, acc).otherwise(F.get(F.transform(F.array(hit), moved), F.lit(0)))

    gap = F.length(a) - F.length(b)
    near = F.abs(gap) <= edits
    end = F.get(F.array(*[F.lit(1 << k) for k in range(width)]), F.when(near, gap + edits))
    other = F.when(F.length(b) > 0, F.split(b, "")).otherwise(F.array().cast("array<string>"))
    last = F.aggregate(other, start, step, lambda acc: acc[names[-1]])
    return near & (last.bitwiseAND(end) != 0)


def within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether two texts are within ``edits`` edits of each other, by what is left of them without equal ends."""
    near = F.abs(F.length(a) - F.length(b)) <= edits
    return near & F.exists(F.array(_cores(a, b)), lambda x: _within(x["a"], x["b"], edits))


def verified(pairs: DataFrame, edits: int = EDITS) -> DataFrame:
    """The pairs whose texts ``line_a`` and ``line_b`` are within ``edits`` edits."""
    a, b = F.col("line_a"), F.col("line_b")
    return pairs.filter(within(a, b, edits))


def _documents(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("doc"), F.split(text, "\n", -1).alias("lines"))


def occurrences(docs: DataFrame, least: int = LEAST, only: DataFrame | None = None) -> DataFrame:
    """Every line of at least ``least`` characters, of the few documents ``only`` if given: its place and two
    hashes that name it."""
    rows = _documents(docs)
    if only is not None:
        rows = rows.join(F.broadcast(only), "doc", "left_semi")
    # outer, though there is always a line: else texts are split a second time to see whether there is one
    rows = rows.select("doc_id", "doc", F.posexplode_outer("lines").alias("pos", "line"))
    rows = rows.withColumn("size", F.length("line")).filter(F.col("size") >= least)
    return rows.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit("second"), "line"))


PLACE = ("doc_id", "doc", "pos")
NAME = ["h1", "h2"]


def _repeated(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, first, k) of the lines that occur more than once; those of them that are frequent, which
    are few by definition."""
    found = every.groupBy(*NAME).agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("k")).filter("k > 1")
    found = materialize(found, "repeated")
    total = found.agg(F.sum("k")).first()[0] or 0
    return found, found.filter(F.col("k") >= max(64, total // FREQUENT))


def members(lines: DataFrame, firsts: DataFrame, often: DataFrame, edits: int = EDITS) -> DataFrame:
    """(key, h1) of the lines that share a key with another line. Occurrences of a frequent line are made
    one first, by ``firsts`` with its first document's lines, so that it weighs no more than any other."""
    often = F.broadcast(often.select(*NAME))
    once = firsts.join(often, NAME, "left_semi").groupBy(*NAME, "size").agg(F.min("line").alias("line"))
    rare = lines.join(often, NAME, "left_anti").select(*NAME, "size", "line")
    dealt = entries(rare, edits).unionByName(entries(once, edits)).repartition("key")
    met = dealt.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter(F.col("low") != F.col("high"))
    return materialize(dealt.join(met.select("key").hint("shuffle_hash"), "key").distinct(), "members")


def facts(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h1, h2, line, size, first, counts) of the lines named by ``wanted``: their first places, and how
    many of a line's characters are in each finer class."""
    hint = F.broadcast if wanted.limit(FEW + 1).count() <= FEW else (lambda df: df)
    found = lines.join(hint(wanted), "h1", "left_semi").groupBy(*NAME, "size")
    found = materialize(found.agg(F.min(F.struct(*PLACE)).alias("first"), F.min("line").alias("line")), "lines")
    chars = found.select(*NAME, F.explode(F.split("line", "")).alias("c"))
    of = F.pmod(F.xxhash64("c"), F.lit(CLASSES))
    counts = chars.select(*NAME, of.alias("of")).groupBy(*NAME).agg(*[F.count_if(F.col("of") == k).alias(f"n{k}") for k in range(CLASSES)])
    counts = counts.select(*NAME, F.array(*[f"n{k}" for k in range(CLASSES)]).alias("counts"))
    return materialize(found.join(counts, NAME), "facts")


def _agreeing(rows: DataFrame, classes: int, edits: int) -> DataFrame:
    """A row for each choice of classes of which lines within ``edits`` edits agree on one, with ``again``
    as the hash of the key and the counts of those classes, hashed class by class in ``sums``."""
    some = F.array(*[F.array(*map(F.lit, c)).cast("array<int>") for c in combinations(range(classes), max(0, classes - 2 * edits))])
    sums = F.array(*[F.xxhash64(*[F.get("counts", F.lit(k)) for k in range(c, CLASSES, classes)]) for c in range(classes)])
    rows = rows.select("key", "h1", "first", "size", "counts", "shared", "open", sums.alias("sums"), F.explode(some).alias("chosen"))
    return rows.withColumn("again", F.xxhash64("key", "chosen", F.transform("chosen", lambda c: F.get(F.col("sums"), c))))


def _first_choice() -> Column:
    """Whether a pair agrees on no class but the chosen ones up to the last of these: once for every pair."""
    upto = F.coalesce(F.array_max("chosen_a") + 1, F.lit(0))
    same = F.zip_with(F.slice("sums_a", F.lit(1), upto), F.slice("sums_b", F.lit(1), upto), lambda x, y: x == y)
    return F.size(F.filter(same, lambda t: t)) == F.size("chosen_a")


def _alike(edits: int) -> Column:
    """Whether two lines' counts differ by no more than ``edits`` edits can change."""
    apart = F.zip_with("counts_a", "counts_b", lambda x, y: F.abs(x - y))
    return F.aggregate(apart, F.lit(0).cast("long"), lambda acc, x: acc + x) <= 2 * edits


def _pairs(rows: DataFrame, open_: DataFrame, key: str, edits: int, more: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, columns of ``more`` as of either): a's of ``open_`` with earlier b's of ``rows`` under one key, in the
    smallest of the buckets that both are in."""
    kept = ("first", "size", "counts", "shared", "key", *more)
    a = open_.select(F.col(key).alias("at"), F.col("h1").alias("a"), *[F.col(c).alias(f"{c}_a") for c in kept])
    b = rows.select(F.col(key).alias("at"), F.col("h1").alias("b"), *[F.col(c).alias(f"{c}_b") for c in kept])
    fits = (F.col("first_b") < F.col("first_a")) & (F.abs(F.col("size_a") - F.col("size_b")) <= edits)
    least = F.array_min(F.array_intersect("shared_a", "shared_b"))["key"] == F.col("key_a")
    return a.join(b, "at").filter(fits & _alike(edits) & least)


def _settled(pairs: DataFrame, known: DataFrame, edits: int) -> DataFrame:
    """(h1, h2) of the lines a that are near their b."""
    side = lambda s: known.select(F.col("h1").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("h2", "line", "first")])
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b").filter("first_b < first_a")
    near = verified(both, edits)
    return materialize(near.select(F.col("a").alias("h1"), F.col("h2_a").alias("h2")).distinct(), "near")


def near_lines(lines: DataFrame, firsts: DataFrame, often: DataFrame, edits: int = EDITS) -> DataFrame:
    """(h1, h2) of the lines that an earlier line is within ``edits`` edits of."""
    met = members(lines, firsts, often, edits)
    known = facts(lines, met.select("h1").distinct())
    sized = met.groupBy("key").agg(F.count("*").alias("n"))
    shared = met.join(sized, "key").groupBy("h1").agg(F.collect_list(F.struct("n", "key")).alias("shared"))
    placed = shared.join(known.select("h1", "first", "size", "counts"), "h1").withColumn("in", F.explode("shared"))
    placed = materialize(placed.select("h1", "first", "size", "counts", "shared", "in.n", "in.key"), "placed")
    small, big = placed.filter(F.col("n") <= SMALL), placed.filter(F.col("n") > SMALL)
    earliest = big.groupBy("key").agg(F.min(F.struct("first", "h1", "counts")).alias("least"))
    earliest = earliest.select("key", F.col("least.h1").alias("b"), F.col("least.counts").alias("counts_b"))
    stars = big.withColumnRenamed("counts", "counts_a").join(earliest, "key").filter((F.col("h1") != F.col("b")) & _alike(edits))
    few = _pairs(small, small, "key", edits).select("a", "b")
    near = _settled(few.union(stars.select(F.col("h1").alias("a"), "b")), known, edits)

    big = big.join(near.select("h1", F.lit(True).alias("settled")), "h1", "left").withColumn("open", F.col("settled").isNull())
    limits = [0, *LARGE, 1 << 62]
    tiers = [_agreeing(big.filter(F.col("n").between(low, high - 1)), c, edits) for c, low, high in zip(COARSE, limits[:-1], limits[1:], strict=True)]
    dealt = materialize(tiers[0].union(tiers[1]).union(tiers[2]), "dealt")
    rest = _pairs(dealt, dealt.filter("open"), "again", edits, ("sums", "chosen")).filter(_first_choice()).select("a", "b")
    return near.union(_settled(rest, known, edits))


def doomed(docs: DataFrame, edits: int = EDITS, least: int = LEAST, exact: int | None = None) -> DataFrame:
    """(doc, removed, n_near): per document key, the numbers of the lines that go."""
    every = occurrences(docs, least if exact is None else min(exact, least))
    repeated, often = _repeated(every)
    firsts = occurrences(docs, least, often.select("first.doc").distinct())
    near = near_lines(every.filter(F.col("size") >= least), firsts, often, edits)
    known = repeated.drop("k").join(near.withColumn("near", F.lit(True)), NAME, "full")
    # frequent lines are known to every task, and their occurrences are not dealt by line
    most = F.broadcast(often.select(*NAME).join(known, NAME).select(*NAME, F.struct("first", "near").alias("most")))
    place = F.struct(*PLACE)
    rows = every.select(*PLACE, *NAME).join(most, NAME, "left")
    rows = rows.withColumn("h1", F.when(F.col("most").isNull(), F.col("h1")).otherwise(F.xxhash64(*PLACE)))
    rows = rows.join(known.join(most, NAME, "left_anti"), NAME, "left")
    first, close = F.coalesce("first", "most.first"), F.coalesce("near", "most.near").isNotNull()
    gone = rows.select("doc", "pos", close.alias("near"), (place != first).alias("later")).filter("near OR later")
    return gone.select("doc", "pos", "near").distinct().groupBy("doc").agg(
        F.sort_array(F.collect_list("pos")).alias("removed"), F.count_if("near").alias("n_near")
    )


def report(docs: DataFrame, edits: int = EDITS, least: int = LEAST, exact: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_near, removed): n_near of the removed lines have an earlier
    near line; ``removed`` lists line numbers from 0."""
    gone = materialize(doomed(docs, edits, least, exact), "gone")
    rows = _documents(docs).select("doc_id", "doc", F.size("lines").cast("long").alias("n_lines")).join(gone, "doc", "left")
    return rows.select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed"),
    )


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, exact: int | None = None, emptied: bool = True) -> DataFrame:
    """The documents without the lines that go, all columns kept; a text without such lines is kept as
    it is. Without ``emptied`` a document that had words and has none left goes too."""
    gone = materialize(doomed(docs, edits, least, exact).select("doc", "removed"), "gone")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(key.alias("doc"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(gone, "doc", "left")
    kept = F.filter(F.split("row.text", "\n", -1), lambda x, i: ~F.array_contains("removed", i))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    rows = rows.select("row", "removed", text.alias("text"))
    if not emptied:
        rows = rows.filter(F.col("removed").isNull() | F.col("text").rlike(WORD) | ~F.col("row.text").rlike(WORD))
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
o AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d),
u AS (SELECT line, length(line) AS n, min(doc_id * 1000000 + pos) AS first FROM o WHERE length(line) >= {LEAST} GROUP BY line),
near AS (
  SELECT DISTINCT b.line FROM u a JOIN u b ON b.n BETWEEN a.n - {EDITS} AND a.n + {EDITS} AND a.first < b.first
  WHERE CASE WHEN left(a.line, a.n // 3) = left(b.line, a.n // 3) OR right(a.line, a.n // 3) = right(b.line, a.n // 3)
      OR contains(b.line, substr(a.line, a.n // 3 + 1, a.n - 2 * (a.n // 3))) THEN levenshtein(a.line, b.line) <= {EDITS} ELSE false END
),
g AS (
  SELECT o.doc_id, o.pos, near.line IS NOT NULL AS near
  FROM o JOIN u ON o.line = u.line LEFT JOIN near ON o.line = near.line
  WHERE near.line IS NOT NULL OR o.doc_id * 1000000 + o.pos <> u.first
),
r AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (near) AS n_near, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS removed FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_near, 0) AS n_near, coalesce(removed, '') AS removed
FROM d LEFT JOIN r USING (doc_id)
"""
