"""Queries over the driver's tables, one per operator, with equivalent SQL where SQL can say it.

Symbol sequences come from whole tables: E, the events of each user in order; N, the distinct part
names as character sequences; families of N share a first letter."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.functions.alphabets import Alphabet, characters, encode
from symloom.functions.matrices import identity
from symloom.model import Options
from symloom.operators import families, pairwise, profiles, tracks
from symloom.sources import text

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "nw_score_global"

EVENTS = Alphabet("events", ("click", "error", "purchase", "signup", "view"))
LETTERS = Alphabet("letters", tuple(" abcdefghijklmnopqrstuvwxyz"))
MATCH, MISMATCH = 2, -1
GAPS, LINEAR = Options(gap_series=(-3.0, -1.0)), Options(gap_series=(-2.0,))
SCORES = identity(LETTERS, MATCH, MISMATCH)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, pos, event_type): every user's events in order."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _table(spark, sf_dir, "events").select("user_id", "event_type", (F.row_number().over(order) - 1).alias("pos"))
    return rows.select("user_id", "pos", "event_type")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family_id, ord, name, sets) of the distinct part names, all in one family."""
    names = _table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    rows = names.withColumn("ord", (F.row_number().over(Window.orderBy("name")) - 1).cast("int"))
    return rows.select(F.lit(0).cast("long").alias("family_id"), "ord", "name", F.array(encode(characters(F.col("name")), LETTERS)).alias("sets"))


def _name_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).withColumn("family_id", F.ascii("name").cast("long"))


def _symbol_counts(spark: SparkSession, sf_dir: str, keep: str = "true") -> DataFrame:
    """Counts per position over the users' event sequences."""
    rows = _events(spark, sf_dir).filter(keep).groupBy("pos", "event_type").agg(F.count("*").alias("cnt"))
    return rows.withColumn("sym", encode(F.array("event_type"), EVENTS)[0]).select("pos", "sym", "cnt")


_CASE = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END"
_E = f"e AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos, event_type, {_CASE} AS sym FROM events)"
_COUNTS = f"{_E}, c AS (SELECT pos, sym, count(*) AS cnt FROM e GROUP BY pos, sym)"
_N = "n AS (SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS ord FROM (SELECT DISTINCT p_name AS name FROM part))"
_P = f"{_N}, p AS (SELECT a.ord AS a, b.ord AS b, a.name AS one, b.name AS two, length(a.name) AS la, length(b.name) AS lb FROM n a JOIN n b ON a.ord < b.ord)"


# symbols and profiles


@query(f"WITH {_E} SELECT user_id, pos, event_type, sym FROM e")
def encode_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).withColumn("sym", encode(F.array("event_type"), EVENTS)[0])


@query(f"WITH {_COUNTS} SELECT pos, sym, cnt FROM c")
def position_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are the items of one alignment without gaps."""
    symbols = encode_symbols(spark, sf_dir).select(F.col("user_id").alias("item"), "pos", "sym")
    start = symbols.select("item", F.lit(0).alias("row")).distinct()
    paths = symbols.select("item", (F.col("pos") + 1).alias("row")).unionByName(start).withColumn("consumed", F.col("row"))
    return profiles.frequencies(profiles.steps(paths, []), symbols, [])


@query(f"WITH {_COUNTS} SELECT pos, sym, cnt, cnt / sum(cnt) OVER (PARTITION BY pos) AS share FROM c")
def profile_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.probabilities(_symbol_counts(spark, sf_dir), [])


@query(f"WITH {_COUNTS} SELECT pos, sym, cnt FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY cnt DESC, sym) AS r FROM c) WHERE r = 1")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.consensus(_symbol_counts(spark, sf_dir), [])


@query(f"WITH {_COUNTS} SELECT pos, sym, cnt FROM c")
def profile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.merge_counts(_symbol_counts(spark, sf_dir, "user_id % 2 = 0"), _symbol_counts(spark, sf_dir, "user_id % 2 <> 0"), [])


@query(
    f"""WITH {_COUNTS}, t AS (SELECT pos, sum(cnt) AS total FROM c GROUP BY pos), s AS (SELECT unnest(range(5)) AS sym_a)
SELECT c.pos, CAST(sym_a AS INTEGER) AS sym_a, sum(cnt * CASE WHEN sym = sym_a THEN 2 ELSE -1 END)::DOUBLE / max(total) AS expected
FROM c JOIN t ON c.pos = t.pos CROSS JOIN s GROUP BY c.pos, sym_a"""
)
def position_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = [(a, b, float(MATCH if a == b else MISMATCH)) for a in range(5) for b in range(5)]
    matrix = spark.createDataFrame(scores, "sym_a int, sym_b int, score double")
    return profiles.expected_scores(_symbol_counts(spark, sf_dir), matrix, [])


# tracks, one-hot profiles and matrix entries


def _user_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, tracks): every user's event codes as track ``input``."""
    rows = encode_symbols(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sym"))).alias("s"))
    return rows.select("user_id", F.create_map(F.lit("input"), F.col("s.sym")).alias("tracks"))


@query(
    f"""WITH {_E}, t AS (SELECT user_id, 'input' AS track, pos, 4 - sym AS sym FROM e UNION ALL SELECT user_id, 'parity', pos, sym % 2 FROM e)
SELECT user_id, track, pos, CAST(sym AS INTEGER) AS sym FROM t"""
)
def track_editing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parity track comes, the input is replaced by its codes counted from the end, a copy of it comes and goes."""
    first = F.element_at("tracks", "input")
    rows = _user_tracks(spark, sf_dir).withColumn("tracks", tracks.add(F.col("tracks"), "parity", F.transform(first, lambda x: (x % 2).cast("int"))))
    rows = rows.withColumn("tracks", tracks.add(F.col("tracks"), "copy", tracks.get(F.col("tracks"), "input")))
    rows = rows.withColumn("tracks", tracks.replace(F.col("tracks"), "input", F.transform(first, lambda x: F.lit(4) - x)))
    rows = rows.withColumn("tracks", tracks.delete(F.col("tracks"), "copy"))
    rows = rows.select("user_id", F.explode("tracks").alias("track", "codes"))
    return rows.select("user_id", "track", F.posexplode("codes").alias("pos", "sym"))


@query("SELECT c_custkey, 'preprofile,' || c_mktsegment || ';' || c_mktsegment || ',preprofile' AS track_sets FROM customer")
def track_set_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = F.array(F.array(F.lit("input"), "c_mktsegment"), F.array("c_mktsegment", F.lit("input")))
    named = tracks.rename_in_sets(sets, "input", "preprofile")
    text_of = F.array_join(F.transform(named, lambda s: F.array_join(s, ",")), ";")
    return _table(spark, sf_dir, "customer").select("c_custkey", text_of.alias("track_sets"))


@query(f"WITH {_E} SELECT user_id, pos, sym, CAST(1 AS BIGINT) AS cnt FROM e")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.one_hot(encode_symbols(spark, sf_dir).select("user_id", "pos", "sym"), ["user_id"])


@query(
    f"""WITH {_E}, f AS (SELECT *, lead(sym) OVER (PARTITION BY user_id ORDER BY pos) AS next FROM e)
SELECT user_id, pos, CASE WHEN sym = next THEN 2.0::DOUBLE WHEN next IS NULL THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS score FROM f"""
)
def matrix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each event with the user's next one; the last has none, which scores 0."""
    rows = encode_symbols(spark, sf_dir).withColumn("sym_b", F.lead("sym").over(Window.partitionBy("user_id").orderBy("pos")))
    scores = [(a, b, float(MATCH if a == b else MISMATCH)) for a in range(5) for b in range(5)]
    matrix = spark.createDataFrame(scores, "sym_a int, sym_b int, score double")
    return profiles.lookup(rows.withColumnRenamed("sym", "sym_a"), matrix).select("user_id", "pos", "score")


# columns of the part names, blanks being gaps


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("ord", F.posexplode(characters(F.col("name"))).alias("pos", "sym"))


@query(
    f"""WITH {_N}, k AS (SELECT ord, unnest(range(length(name))) AS pos, unnest(string_split(name, '')) AS sym FROM n),
c AS (SELECT pos, sym, count(*) AS cnt FROM k WHERE sym <> ' ' GROUP BY pos, sym),
t AS (SELECT a.pos, sum(a.cnt * b.cnt * CASE WHEN a.sym = b.sym THEN 2 ELSE -1 END) AS total FROM c a JOIN c b ON a.pos = b.pos GROUP BY a.pos)
SELECT CAST(pos AS INTEGER) AS pos, CASE WHEN total >= 0.9 * 2 * w THEN '*' WHEN total >= 0.4 * 2 * w THEN ':' ELSE ' ' END AS mark
FROM t, (SELECT count(*) * count(*) AS w FROM n)"""
)
def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _columns(spark, sf_dir).filter("sym <> ' '").groupBy("pos", "sym").agg(F.count("*").alias("cnt"))
    return profiles.conservation(counts, SCORES.table(spark).withColumn("score", F.col("score").cast("double")), [], _names(spark, sf_dir).count())


_RUN = f"""{_N}, k AS (SELECT ord, unnest(range(length(name))) AS col, unnest(string_split(name, '')) AS symbol FROM n),
r AS (SELECT ord, CAST(col AS INTEGER) AS col, symbol, sum(CASE WHEN symbol <> ' ' THEN 1 ELSE 0 END) OVER (PARTITION BY ord ORDER BY col) AS consumed FROM k)"""


@query(f"WITH {_RUN} SELECT ord, col, symbol, CAST(consumed AS BIGINT) AS consumed FROM r")
def path_from_gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.paths_from_gapped(_names(spark, sf_dir), ["ord"], "name", " ")


def _gapped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-item paths: columns of a name, and its characters without blanks."""
    rows = path_from_gapped(spark, sf_dir).select("ord", (F.col("col") + 1).alias("row"), "consumed")
    start = _names(spark, sf_dir).select("ord", F.lit(0).alias("row"), F.lit(0).cast("long").alias("consumed"))
    rows = rows.unionByName(start)
    one = rows.select("ord", "row", F.lit(0).alias("item"), F.col("row").cast("long").alias("consumed"))
    return one.unionByName(rows.select("ord", "row", F.lit(1).alias("item"), "consumed"))


@query(
    f"""WITH {_RUN}, h AS (SELECT ord, CAST(col + 1 AS INTEGER) AS row, consumed FROM r WHERE symbol <> ' ' UNION ALL SELECT ord, 0, 0 FROM n)
SELECT ord, row, 0 AS item, CAST(row AS BIGINT) AS consumed FROM h UNION ALL SELECT ord, row, 1 AS item, CAST(consumed AS BIGINT) AS consumed FROM h"""
)
def path_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.compress(_gapped_paths(spark, sf_dir), ["ord"], 1)


@query(f"WITH {_RUN} SELECT ord, CAST(1 AS INTEGER) AS item, col, CAST(consumed - 1 AS BIGINT) AS pos FROM r WHERE symbol <> ' '")
def path_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.steps(_gapped_paths(spark, sf_dir).filter("item = 1"), ["ord"])


@query(
    f"""WITH {_RUN}, h AS (SELECT ord, CAST(col + 1 AS INTEGER) AS row, consumed FROM r UNION ALL SELECT ord, 0, 0 FROM n)
SELECT ord, row, 0 AS item, CAST(consumed AS BIGINT) AS consumed FROM h"""
)
def alignment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-item alignment (the characters without blanks) spread over the columns of a guide path."""
    guide = _gapped_paths(spark, sf_dir)
    plain = guide.filter("item = 1").groupBy("ord").agg(F.max("consumed").alias("n"))
    path = plain.select("ord", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("row")).select("ord", "row", F.lit(0).alias("item"), F.col("row").alias("consumed"))
    return profiles.merge_paths(guide, path, ["ord"], 1)


# pairs


@query(f"WITH {_P} SELECT a, b FROM p")
def pairs_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.unordered_pairs(_names(spark, sf_dir)).select("a", "b")


@query(f"WITH {_N} SELECT a.ord AS a, count(*) AS others FROM n a JOIN n b ON a.ord <> b.ord GROUP BY a.ord")
def others_per_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.ordered_pairs(_names(spark, sf_dir)).groupBy("a").agg(F.count("*").alias("others"))


@query(f"WITH {_P} SELECT a, b, CASE WHEN la > lb THEN 'semiglobal_one' ELSE 'semiglobal_two' END AS mode FROM p")
def auto_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.unordered_pairs(_names(spark, sf_dir)).select("a", "b", pairwise.auto_mode(F.col("one")[0], F.col("two")[0]).alias("mode"))


@query(
    f"""WITH {_P}, y AS (SELECT *, unnest(range(la)) AS y FROM p), x AS (SELECT *, unnest(range(lb)) AS x FROM y)
SELECT a, b, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x,
  CAST(CASE WHEN substr(one, y + 1, 1) = substr(two, x + 1, 1) THEN {MATCH} ELSE {MISMATCH} END AS DOUBLE) AS score FROM x"""
)
def match_score_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pairwise.unordered_pairs(_names(spark, sf_dir))
    alphabet = [(i, j, float(MATCH if i == j else MISMATCH)) for i in LETTERS.indices for j in LETTERS.indices]
    matrix = F.broadcast(spark.createDataFrame(alphabet, "sym_a int, sym_b int, score double"))
    rows = pairs.select("family_id", "a", "b", F.col("one")[0].alias("one"), F.col("two")[0].alias("two"))
    return pairwise.match_grid(rows, matrix).select("a", "b", "y", "x", "score")


def _score(spark: SparkSession, sf_dir: str, mode: str, opt: Options) -> DataFrame:
    pairs = pairwise.unordered_pairs(_names(spark, sf_dir))
    rows = pairwise.align_pairs(pairs, [SCORES.dense], opt, mode)
    return rows.select("a", "b", F.col("score").cast("double").alias("score"))


def _fill_sql(mode: str, opt: Options, pairs: str = _P) -> str:
    """The recurrence as a recursive query over rows, ``d``: M and U look at the row before, L is a
    running maximum along the row."""
    (go, ge), low = opt.gaps, -1_000_000
    free_one = mode in ("semiglobal_both", "semiglobal_one")
    free_two = mode in ("semiglobal_both", "semiglobal_two")
    u0 = "0" if free_one else f"({go} + y * {ge})"  # of row y + 1
    l0 = "0" if free_two else f"({go} + (x - 1) * {ge})"
    corner_u, corner_l = ("0" if f else f"{go - ge}" for f in (free_one, free_two))
    floor = "greatest(0, {})" if mode == "local" else "{}"
    best = floor.format("greatest(pm, pu, pl) + CASE WHEN substr(one, y + 1, 1) = substr(two, x, 1) THEN {} ELSE {} END".format(MATCH, MISMATCH))
    return f"""
WITH RECURSIVE {pairs}, d AS (
  SELECT a, b, one, two, la, lb, 0 AS y, x, CASE WHEN x = 0 THEN 0.0 ELSE {low} END::DOUBLE AS m,
    CASE WHEN x = 0 THEN {corner_u} ELSE {low} END::DOUBLE AS u, CASE WHEN x = 0 THEN {corner_l} ELSE {l0} END::DOUBLE AS l
  FROM (SELECT *, unnest(range(lb + 1)) AS x FROM p)
  UNION ALL
  SELECT a, b, one, two, la, lb, y + 1, x, nm, nu,
    CASE WHEN x = 0 THEN {low} ELSE greatest({low}, coalesce(max(CASE WHEN x > 0 THEN nm - x * {ge} END) OVER (PARTITION BY a, b ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {low}) + {go} + (x - 1) * {ge}) END::DOUBLE
  FROM (
    SELECT *, CASE WHEN x = 0 THEN {low} ELSE {best} END::DOUBLE AS nm, CASE WHEN x = 0 THEN {u0} ELSE greatest(m + {go}, u + {ge}) END::DOUBLE AS nu
    FROM (SELECT *, lag(m) OVER w AS pm, lag(u) OVER w AS pu, lag(l) OVER w AS pl FROM d WHERE y < la WINDOW w AS (PARTITION BY a, b ORDER BY x))
  )
)"""


def _dp_sql(mode: str, opt: Options) -> str:
    end = {
        "global": "max(greatest(m, u, l)) FILTER (y = la AND x = lb)",
        "local": "max(greatest(m, u, l))",
    }.get(mode)
    if end is None:
        row, column = "max(greatest(m, u, l)) FILTER (y = la)", "max(greatest(m, u, l)) FILTER (x = lb)"
        end = column if mode == "semiglobal_one" else f"greatest({row}, {column})"
    return f"{_fill_sql(mode, opt)} SELECT a, b, {end}::DOUBLE AS score FROM d GROUP BY a, b"


def _paths_sql(opt: Options, pairs: str = _P) -> str:
    """Global alignments traced back from their ends, ``t``: k steps from the end a path is at (y, x)."""
    go = opt.gaps[0]
    return f"""{_fill_sql("global", opt, pairs)}, cell AS MATERIALIZED (SELECT a, b, y, x, m, u, l FROM d), t AS (
  SELECT a, b, one, two, 0 AS k, y, x, m, u, l, CASE WHEN m >= u AND m >= l THEN 'm' WHEN u >= l THEN 'u' ELSE 'l' END AS s FROM d WHERE y = la AND x = lb
  UNION ALL
  SELECT t.a, t.b, one, two, k + 1, c.y, c.x, c.m, c.u, c.l, CASE
    WHEN s = 'm' AND t.m = c.m + CASE WHEN substr(one, t.y, 1) = substr(two, t.x, 1) THEN {MATCH} ELSE {MISMATCH} END THEN 'm'
    WHEN s = 'm' AND t.m = c.u + CASE WHEN substr(one, t.y, 1) = substr(two, t.x, 1) THEN {MATCH} ELSE {MISMATCH} END THEN 'u'
    WHEN s = 'm' THEN 'l'
    WHEN s = 'u' THEN CASE WHEN t.u = c.m + {go} THEN 'm' ELSE 'u' END
    ELSE CASE WHEN t.l = c.m + {go} THEN 'm' ELSE 'l' END END
  FROM t JOIN cell c ON c.a = t.a AND c.b = t.b AND c.y = t.y - CASE WHEN s = 'l' THEN 0 ELSE 1 END AND c.x = t.x - CASE WHEN s = 'u' THEN 0 ELSE 1 END
)"""


def _score_query(name: str, mode: str, opt: Options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _score(spark, sf_dir, mode, opt)

    run.__name__ = name
    query(_dp_sql(mode, opt))(run)


_score_query("nw_score_global", "global", GAPS)
_score_query("nw_score_linear_gap", "global", LINEAR)
_score_query("semiglobal_score_both", "semiglobal_both", GAPS)
_score_query("semiglobal_score_one", "semiglobal_one", GAPS)
_score_query("semiglobal_score_two", "semiglobal_two", GAPS)
_score_query("local_score", "local", GAPS)


@query(f"WITH s AS ({_dp_sql('global', GAPS)}) SELECT a, b, score, greatest(max(score) OVER (), 0) - score AS distance FROM s")
def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = families.distances(_names(spark, sf_dir), [SCORES.dense], GAPS)
    return rows.select("a", "b", F.col("score").cast("double").alias("score"), F.col("distance").cast("double").alias("distance"))


@query(
    f"""{_paths_sql(GAPS)}, h AS (SELECT a, b, CAST(max(k) OVER (PARTITION BY a, b) - k AS INTEGER) AS row, y, x FROM t)
SELECT a, b, row, 0 AS item, CAST(y AS INTEGER) AS consumed FROM h UNION ALL SELECT a, b, row, 1 AS item, CAST(x AS INTEGER) AS consumed FROM h"""
)
def global_alignment_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pairwise.align_pairs(pairwise.unordered_pairs(_names(spark, sf_dir)), [SCORES.dense], GAPS, "global", True)
    return profiles.long_paths(done, ["a", "b"])


# families


_FAMILY_PAIRS = f"""{_N}, p AS (SELECT a.ord AS a, b.ord AS b, a.name AS one, b.name AS two, length(a.name) AS la, length(b.name) AS lb
  FROM n a JOIN n b ON ascii(a.name) = ascii(b.name) AND a.ord <> b.ord)"""


@query(
    f"""{_paths_sql(GAPS, _FAMILY_PAIRS)}, h AS (SELECT a, b, k, y, x, two, lag(y) OVER (PARTITION BY a, b ORDER BY k DESC) AS was FROM t),
kept AS (SELECT a, y, x, two, lag(x) OVER (PARTITION BY a, b ORDER BY k DESC) AS before FROM h WHERE was IS NULL OR y > was),
held AS (SELECT a AS ord, y - 1 AS pos, substr(two, x, 1) AS symbol FROM kept WHERE x > before
  UNION ALL SELECT ord, i, substr(name, i + 1, 1) FROM (SELECT *, unnest(range(length(name))) AS i FROM n))
SELECT CAST(ascii(name) AS BIGINT) AS family_id, ord, CAST(pos AS INTEGER) AS pos,
  strpos(' abcdefghijklmnopqrstuvwxyz', symbol)::INTEGER - 1 AS sym, count(*) AS cnt FROM held JOIN n USING (ord) GROUP BY ALL"""
)
def preprofile_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.preprofiles(_name_families(spark, sf_dir), [SCORES.dense], GAPS)


@query()
def preprofile_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.preprofiles(_name_families(spark, sf_dir), [SCORES.dense], GAPS.merge(preprofile_mode="local", score_threshold=2.0))


@query(
    f"""WITH {_N} SELECT CAST(ascii(name) AS BIGINT) AS family_id, ord, CAST(i AS INTEGER) AS pos,
  strpos(' abcdefghijklmnopqrstuvwxyz', substr(name, i + 1, 1))::INTEGER - 1 AS sym, 1::BIGINT AS cnt
FROM (SELECT *, unnest(range(length(name))) AS i FROM n)"""
)
def preprofile_dummy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.preprofiles(_name_families(spark, sf_dir), [SCORES.dense], GAPS.merge(preprofile_mode="dummy"))


def _tree_sql(linkage: str) -> str:
    """Clusters keep their least member; ``r`` holds all pairs of clusters of a step."""
    join = {"single": "min", "complete": "max", "average": "sum"}[linkage]
    mean = "link / n" if linkage == "average" else "link"
    return f"""WITH RECURSIVE s AS ({_dp_sql("global", GAPS)}), r AS (
  SELECT 0 AS step, a, b, greatest(max(score) OVER (), 0) - score AS link, CAST(1 AS BIGINT) AS n FROM s
  UNION ALL
  SELECT step, least(i, j), greatest(i, j), {join}(link), CAST(sum(n) AS BIGINT) FROM (
    SELECT step + 1 AS step, CASE WHEN a = q THEN p ELSE a END AS i, CASE WHEN b = q THEN p ELSE b END AS j, link, n
    FROM (SELECT *, first_value(a) OVER w AS p, first_value(b) OVER w AS q FROM r WINDOW w AS (ORDER BY {mean}, a, b))
  ) WHERE i <> j GROUP BY step, least(i, j), greatest(i, j)
)
SELECT CAST(0 AS BIGINT) AS family_id, step, a AS "left", b AS "right"
FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY {mean}, a, b) AS k FROM r) WHERE k = 1"""


def _tree(linkage: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        opt = GAPS.merge(linkage=linkage)
        return families.guide_trees(families.distances(_names(spark, sf_dir), [SCORES.dense], opt), opt)

    run.__name__ = f"guide_tree_{linkage}"
    return query(_tree_sql(linkage))(run)


for _linkage in ("single", "complete", "average"):
    _tree(_linkage)


def _msa(name: str, opt: Options, tracks: int = 1) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _name_families(spark, sf_dir)
        vowels = F.transform(F.col("sets")[0], lambda s: F.array_contains(F.array(*[F.lit(LETTERS.index(c)) for c in "aeiou"]), s).cast("int"))
        matrices = [SCORES.dense, np.array([[0, 0], [0, 3]], dtype=np.float32)][:tracks]
        rows = rows.withColumn("sets", F.array(F.col("sets")[0], vowels)) if tracks > 1 else rows
        done = families.align_families(rows, matrices, opt)
        return families.gapped_rows(done, _name_families(spark, sf_dir).select("family_id", "ord", F.col("name").alias("text")))

    run.__name__ = name
    return query()(run)


_msa("msa_tree", GAPS.merge(msa_mode="tree", merge_mode="global"))
_msa("msa_adhoc", GAPS.merge(msa_mode="adhoc"))
_msa("msa_tree_semiglobal_auto", GAPS.merge(msa_mode="tree", merge_mode="semiglobal_auto", dist_mode="semiglobal_auto", preprofile_mode="dummy"))
_msa("msa_multitrack", GAPS.merge(msa_mode="tree", merge_mode="global"), tracks=2)


# formats


@query("SELECT c_nationkey, md5(string_agg('>' || c_name || chr(10) || substr(r, 1, 78) || chr(10) || substr(r, 79), chr(10) ORDER BY c_custkey)) AS digest FROM (SELECT *, rpad(repeat(c_mktsegment, 12), 90, 'x') AS r FROM customer) GROUP BY c_nationkey")
def fasta_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select(
        "c_nationkey", F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"), F.rpad(F.repeat("c_mktsegment", F.lit(12)), 90, "x").alias("residues")
    )
    return text.fasta_text(rows, ["c_nationkey"]).select("c_nationkey", F.md5(F.col("value").cast("binary")).alias("digest"))


@query("SELECT c_nationkey, md5(string_agg('>' || substr(repeat(c_name, 5), 1, 71) || chr(10) || substr(r, 1, 72) || chr(10) || substr(r, 73) || chr(10), '' ORDER BY c_custkey)) AS digest FROM (SELECT *, rpad(repeat(c_mktsegment, 12), 90, '-') AS r FROM customer) GROUP BY c_nationkey")
def aligned_fasta_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select(
        "c_nationkey", F.col("c_custkey").alias("ord"), F.repeat("c_name", F.lit(5)).alias("name"), F.rpad(F.repeat("c_mktsegment", F.lit(12)), 90, "-").alias("gapped")
    )
    return text.aligned_fasta_text(rows, ["c_nationkey"]).select("c_nationkey", F.md5(F.col("value").cast("binary")).alias("digest"))


@query("SELECT p_brand AS path, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS ord, p_partkey || ' ' || p_type AS name, replace(p_name, ' ', '') || p_type AS residues FROM part")
def fasta_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    lines = F.concat(F.lit(">"), "p_partkey", F.lit(" "), "p_type", F.lit("  \n"), F.replace("p_name", F.lit(" "), F.lit("\n ")), F.lit("\n"), "p_type", F.lit("\n"))
    records = F.sort_array(F.collect_list(F.struct("p_partkey", lines.alias("t"))))
    files = part.groupBy(F.col("p_brand").alias("path")).agg(F.concat(F.lit("lost\n>\nempty name\n>empty body\n"), F.array_join(F.transform(records, lambda r: r["t"]), "")).alias("value"))
    return text.parse_fasta(files)


@query(f"WITH {_E} SELECT user_id, pos + 1 AS first, pos + 1 AS last, 'event_error' AS type FROM e WHERE event_type = 'error'")
def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = _events(spark, sf_dir).select("user_id", F.lit("event").alias("track"), "pos", F.col("event_type").alias("symbol"))
    return text.feature_rows(symbols, {"event_error": "red"}, ["user_id"])


@query(
    """SELECT o_custkey, o_orderkey, rank, evalue FROM (SELECT o_custkey, o_orderkey,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS rank, o_totalprice / 100000 AS evalue FROM orders)
WHERE rank <= 10 AND evalue <= 1.0"""
)
def hit_filter_limit_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    hits = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).alias("rank"), (F.col("o_totalprice") / 100000).alias("evalue"))
    return text.best_hits(hits)
