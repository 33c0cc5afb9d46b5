"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule's regex gives a Boolean trigram query. The index holds postings (trigram, doc_id) of the
trigrams that some rule asks for; postings are intersected per document by or-ing trigram bits and
testing every rule's query on them, and only the rules whose query holds are run on the text. A
rule without mandatory trigrams is run on every text. Candidates are named to every task up to
``FEW`` of them, so texts stay where they are read, and joined by a shuffle beyond.

Spans come from two passes of one regex: the matches, and the gaps between them, whose lengths in
code points add up to positions by doubling steps, each over the whole array. Matches too short for their rule are dropped after matching, as
they use up the characters that they cover.

Defined results: null text is empty text; rows without a doc_id are scanned by every rule; repeated
rows are scanned alike; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm import trigrams
from symloom.llm.common import materialize, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``group`` must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three base kinds, then further kinds by their issuers' published formats.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"[a-z]+://[A-Za-z0-9_.-]+:[A-Za-z0-9_.-]+@"),
)
RULES = BASE + MORE
#: Candidates are broadcast up to so many (some 20 bytes each).
FEW = 1_000_000


class Plan:
    """The rules' queries and the numbered trigrams of the index."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.queries = [trigrams.query(r.pattern) for r in rules]
        self.terms = sorted({t for q in self.queries for t in trigrams.terms(q)})
        if len(self.terms) > 62 * 8:
            raise ValueError("too many distinct trigrams")
        self.words = -(-len(self.terms) // 62)

    def holds(self, q: trigrams.Query) -> Column:
        if isinstance(q, str):
            i = self.terms.index(q)
            return F.col(f"bits{i // 62}").bitwiseAND(F.lit(1 << i % 62)) != 0
        parts = [self.holds(p) for p in q[1:]]
        return reduce((lambda a, b: a & b) if q[0] == "and" else (lambda a, b: a | b), parts)


def postings(docs: DataFrame, plan: Plan) -> DataFrame:
    """(term, doc_id): the inverted index of the plan's trigrams, over lower-cased texts."""
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    numbered = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(plan.terms)])
    held = F.filter(numbered, lambda x: F.contains(F.col("low"), x["t"]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), low.alias("low"))
    return rows.select("doc_id", F.explode(F.transform(held, lambda x: x["i"])).alias("term")).distinct()


def candidates(index: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, rules): a bit for each rule whose query the document's postings meet."""
    bits = [
        F.bit_or(F.when(F.floor(F.col("term") / 62) == w, F.expr("shiftleft(1L, term % 62)")).otherwise(F.lit(0).cast("long"))).alias(f"bits{w}")
        for w in range(plan.words)
    ]
    met = index.groupBy("doc_id").agg(*bits)
    flags = [F.when(plan.holds(q), 1 << k).otherwise(0) for k, q in enumerate(plan.queries) if q != trigrams.ANY]
    return met.select("doc_id", reduce(lambda a, b: a + b, flags).alias("rules")).filter("rules <> 0")


SPANS = "array<struct<start:int,kind:int,stop:int>>"


def matches(text: Column, rule: Rule) -> Column:
    """(n, stop, kept) of a rule's matches in order: length, that of the gap before added, whether the
    match is long enough. The gap after the last match ends the array with nulls."""
    found, gaps = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    # a match alone matches as it did in its text: no pattern looks around itself
    value = (lambda m: F.regexp_extract(m, rule.pattern, rule.group)) if rule.group else (lambda m: m)
    both = lambda m, gap: F.struct(
        F.length(m).alias("n"), (F.length(gap) + F.length(m)).alias("stop"), (F.length(value(m)) >= rule.least).alias("kept")
    )
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), F.zip_with(found, gaps, both))


def spans(found: Column, number: int) -> Column:
    """The spans of a rule's matches, kinds by their number."""
    stops = F.transform(found, lambda x: x["stop"])
    # after the step of p every stop is the sum over the last 2 * p matches
    powers = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda p: p < F.size(found))
    stops = F.aggregate(powers, stops, lambda acc, p: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - p), F.lit(0))))
    span = lambda x, stop: F.when(x["kept"], F.struct((stop - x["n"]).alias("start"), F.lit(number).alias("kind"), stop.alias("stop")))
    return F.coalesce(F.filter(F.zip_with(found, stops, span), lambda x: x.isNotNull()), F.array().cast(SPANS))


def _least(rule: Rule) -> Rule:
    """Runs of one class are maximal, so their least length may go into the pattern: the same spans,
    and a scan that does not stop at every short run."""
    if rule.kind == "hex":
        return Rule(rule.kind, r"[0-9a-f]{%d,}" % rule.least)
    return rule


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, found): every span of every rule, by start, then by the rules' order."""
    plan = Plan(rules)
    index = materialize(postings(docs, plan), "postings")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    wanted = materialize(candidates(index, plan), "candidates")
    few = wanted.limit(FEW + 1).count() <= FEW
    rows = rows.join(F.broadcast(wanted) if few else wanted, "doc_id", "left")
    met = {}
    for k, rule in enumerate(rules):
        found = matches(F.col("text"), _least(rule))
        if plan.queries[k] != trigrams.ANY:
            met_by = F.col("doc_id").isNull() | (F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << k)) != 0)
            found = F.when(met_by, found)
        met[f"found{k}"] = found
    rows = rows.select("doc_id", *[c.alias(name) for name, c in met.items()])
    return rows.select("doc_id", F.array_sort(F.concat(*[spans(F.col(name), k) for k, name in enumerate(met)])).alias("found"))


def _joined(found: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    rows = scan(docs, rules)
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("found", lambda x: x["kind"] < len(BASE))
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(_joined(base, rules).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("found"), rules).alias("spans"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same spans by each rule's regex on every text."""
    parts = []
    for k, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{p}', 0) AS m, "
            f"regexp_extract_all(t, '{p}', {r.group}) AS v, string_split_regex(t, '{p}') AS g FROM d"
        )
    union = "\n  UNION ALL ".join(parts)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS ({union}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM r),
s AS (
  SELECT doc_id, k, kind, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS n
  FROM i WHERE length(v[i]) >= least
),
f AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, k) FILTER (k < 3) AS base,
    string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, k) AS spans
  FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (doc_id)
"""
