"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into few, then more segments; of each only mean and deviation are kept. For one
segment of n values, a.b <= n * (mean_a * mean_b + dev_a * dev_b), which is the lower bound of the
squared distance, n * ((mean_a - mean_b)^2 + (dev_a - dev_b)^2), read for a given pair of norms.
Pairs whose coarse bound is below the query's k-th best score so far are dropped, then those whose
fine bound is, and only the rest are computed exactly, in integers.

Queries go in chunks of bounded size, one pass over the vectors for each, whose result is written
before the next begins: a chunk is the only thing sent to executors and is released after its pass,
each task keeps the k best per query of its own rows, and the tasks' short lists meet by query.

Defined results: vectors that are null or hold null or non-finite values take no part; vectors of
unequal length are compared over the positions both have; rows with the query's own id are not its
candidates; equal scores go by the smaller id (repeated rows of one id both count); a repeated query
row is answered each time; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.llm.common import materialize, table

#: Bytes of queries of one pass, and rows of vectors and of queries that meet in memory at once.
CHUNK, ROWS, QUERIES = 64 << 20, 8_192, 1_024
SEGMENTS = (4, 16)
SCALE = 256


def usable(column: str) -> Column:
    x = F.col(column)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return x.isNotNull() & F.coalesce(fine, F.lit(False))


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Lists of numbers as rows of floor(SCALE * x), short ones filled with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = max(width, int(lengths.max(initial=0)), 1)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _fit(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def statistics(a: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(n) * mean and sqrt(n) * deviation per segment: the product of two such rows is the bound."""
    edges = np.unique(np.linspace(0, a.shape[1], min(segments, a.shape[1]) + 1).astype(int))
    size = np.diff(edges)
    mean = np.add.reduceat(a, edges[:-1], axis=1) / size
    square = np.add.reduceat(a * a, edges[:-1], axis=1) / size
    return np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0))]) * np.tile(np.sqrt(size), 2)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.n = k, n
        self.score = np.full((n, k), -np.inf, dtype=np.longdouble)  # holds every 64-bit score exactly
        self.ids = np.zeros((n, k), dtype=np.int64)

    def merge(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q = np.concatenate([np.repeat(np.arange(self.n), self.k), query])
        s, i = np.concatenate([self.score.ravel(), score]), np.concatenate([self.ids.ravel(), ids])
        order = np.lexsort((i, -s, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        order = order[place < self.k]
        self.score, self.ids = s[order].reshape(self.n, self.k), i[order].reshape(self.n, self.k)


def scan(best: Best, queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
    """Bring ``rows`` into ``best``: coarse bounds, fine bounds, then exact scores of what is left."""
    width = max(queries.shape[1], rows.shape[1])
    queries, rows = _fit(queries, width), _fit(rows, width)
    levels = [(statistics(queries, s), statistics(rows, s)) for s in SEGMENTS]
    slack = 1e-9 * float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * width + 1e-6
    coarse = levels[0][0] @ levels[0][1].T + slack
    coarse[own[:, None] == ids[None, :]] = -np.inf
    first = min(4 * best.k, len(ids))
    top = np.argpartition(-coarse, first - 1, axis=1)[:, :first]
    q = np.repeat(np.arange(len(queries)), first)
    _exact(best, queries, rows, ids, q, top.ravel(), own)
    np.put_along_axis(coarse, top, -np.inf, axis=1)
    q, c = np.nonzero((coarse >= best.score[:, -1:]) & np.isfinite(coarse))
    for a in range(0, len(q), 1 << 17):
        qa, ca = q[a : a + (1 << 17)], c[a : a + (1 << 17)]
        for fine_q, fine_r in levels[1:]:
            keep = np.einsum("ij,ij->i", fine_q[qa], fine_r[ca]) + slack >= best.score[qa, -1]
            qa, ca = qa[keep], ca[keep]
        _exact(best, queries, rows, ids, qa, ca, own)


def _exact(best: Best, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, c: np.ndarray, own: np.ndarray) -> None:
    mine = own[q] != ids[c]
    q, c = q[mine], c[mine]
    if float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1] < 2**53:
        score = np.einsum("ij,ij->i", queries[q], rows[c]).astype(np.longdouble)
    else:  # beyond exact doubles: whole numbers of any size, held to the range of a long
        dots = (sum(int(a) * int(b) for a, b in zip(queries[i], rows[j], strict=True)) for i, j in zip(q, c, strict=True))
        score = np.array([np.longdouble(max(-(2**63), min(2**63 - 1, d))) for d in dots], dtype=np.longdouble)
    keep = score >= best.score[q, -1]
    if keep.any():
        best.merge(q[keep], score[keep], ids[c[keep]])


FOUND = "query long, vec_id long, score long"


def _search(vectors: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, Broadcast]:
    """One pass for one chunk of queries (``vec_id``, ``embedding``), and what it has sent to the tasks."""
    asked = queries.toArrow()
    own, wanted = asked.column("vec_id").to_numpy(), _matrix(asked.column("embedding"))
    sent = vectors.sparkSession.sparkContext.broadcast((own, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, wanted = sent.value
        parts = [(a, Best(min(QUERIES, len(own) - a), k)) for a in range(0, len(own), QUERIES)]
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some = batch.slice(at, ROWS)
                ids, rows = some.column(0).to_numpy(), _matrix(some.column(1))
                for a, best in parts:
                    scan(best, wanted[a : a + best.n], own[a : a + best.n], rows, ids)
        for a, best in parts:
            q, j = np.nonzero(np.isfinite(best.score))
            yield pa.RecordBatch.from_arrays(
                [pa.array(q + a), pa.array(best.ids[q, j]), pa.array(best.score[q, j].astype(np.int64))], names=["query", "vec_id", "score"]
            )

    found = vectors.mapInArrow(run, FOUND)
    place = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ids = vectors.sparkSession.createDataFrame(pa.table({"query": np.arange(len(own)), "query_id": own}), "query long, query_id long")
    found = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    found = found.join(F.broadcast(ids), "query").select("query_id", "rank", "vec_id", "score")
    return found, sent


def _numbered(queries: DataFrame) -> tuple[DataFrame, int]:
    """The queries, written, with numbers from 0 without gaps; how many they are."""
    rows = materialize(queries.withColumn("place", F.monotonically_increasing_id()), "queries")
    part = F.shiftright("place", 33)
    counts = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    first, total = {}, 0
    for k in sorted(counts):
        first[k], total = total, total + counts[k]
    starts = rows.sparkSession.createDataFrame(list(first.items()), "part long, first long")
    rows = rows.withColumn("part", part).join(F.broadcast(starts), "part")  # a row for each task that wrote queries
    return rows.select("vec_id", "embedding", (F.col("first") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("number")), total


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, chunk: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest scores among the other vectors. Chunks
    run one after another; the driver and the tasks hold one of them, of ``CHUNK`` bytes, at a time."""
    vectors = vectors.filter(usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    queries = queries.filter(usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    queries, n = _numbered(queries)
    if chunk is None:
        width = queries.agg(F.max(F.size("embedding"))).first()[0] or 1
        chunk = max(1, CHUNK // (8 * max(1, width)))
    out = None
    for at in range(0, max(n, 1), chunk):
        found, sent = _search(vectors, queries.filter(F.col("number").between(at, at + chunk - 1)), k)
        found = materialize(found, "found")
        sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5
"""
