"""Toxicity scores: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is lower-cased, cut into words of letters and digits, and every word into byte n-grams with
its boundaries marked; each n-gram falls in one of a fixed number of hashed buckets, and buckets
hold embeddings, so a misspelling that was never seen shares most vectors with its word. The bags
of a run of ``BLOCK`` words are averaged and go through a two-class softmax; embeddings and softmax
are learned together by Adagrad. A text scores as its most toxic block, so length does not dilute
it; blocks of a toxic training text that the model finds harmless stop counting as toxic after the
first passes. Scores are calibrated on a part of the sample that training did not see, at the class
shares of all usable labels.

As the model is linear after averaging, a bucket adds one number to its block's logit: executors get
a table of ``BUCKETS`` floats, whatever the size of the corpus.

The sample is bounded: at most ``PER_CLASS`` labelled texts of each class, chosen by hash among those
of at most ``LONGEST`` bytes. A class without such texts gives its shortest long ones, whole, as many
as ``LONG`` bytes hold and one at least. Scoring always reads whole texts.

Defined results: null and empty texts, and texts without words, score the share of toxic labels; labels
that are null or have no document are not used, a document with several labels is toxic if one says
so; without both classes every score is the share of toxic labels (0 without labels); repeated rows
are scored alike; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.common import materialize, table

BUCKETS, WIDTH = 1 << 17, 8
GRAMS = (3, 4, 5, 6)
BLOCK = 96
PER_CLASS, LONGEST, LONG = 2_000, 16_384, 1 << 23
RATE, BATCH = 0.5, 64
#: Passes: as many as show so many blocks, within these bounds.
VISITS, EPOCHS = 80_000, (4, 40)
#: In calibration a toxic text counts as so many: a missed one is worse than a clean one wrongly marked.
MISS = 2.0
FOLDS = 5

#: What separates words: every ASCII byte but letters and digits becomes a blank.
LETTERS = np.array([c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], dtype=np.uint8)


def _grams(texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Each block's text, and per n-gram size the buckets and their blocks, in text order. Places are
    narrowed from size to size: an n-gram may hold a blank only at its ends."""
    raw = [b"  " + (t or "").lower().encode() + b" " for t in texts]
    data = LETTERS[np.frombuffer(b"".join(raw) + b" " * max(GRAMS), np.uint8)]
    size = np.array([len(r) for r in raw])
    first = np.cumsum(size) - size
    solid = data != 32
    start = np.zeros(len(data), dtype=bool)
    start[1:] = ~solid[:-1] & solid[1:]  # first byte of a word
    begins = np.flatnonzero(start)
    words = np.searchsorted(begins, np.append(first, len(data)))  # before each text
    blocks = np.maximum(1, -(-np.diff(words) // BLOCK))
    base = np.cumsum(blocks) - blocks
    text = np.repeat(np.arange(len(raw)), np.diff(words))
    block = (base[text] + (np.arange(len(begins)) - words[text]) // BLOCK).astype(np.int32)
    number = np.cumsum(start, dtype=np.int32)
    value = data.astype(np.uint64) + np.uint64(1)
    at = np.flatnonzero(solid[1:]).astype(np.int32)
    at = at[at < len(data) - max(GRAMS)]
    code = value[at] * _PRIME + value[at + 1]
    where = block[number[at + 1] - 1]
    out = []
    for n in range(3, max(GRAMS) + 1):
        if n > 3:
            keep = solid[at + n - 2]
            at, code, where = at[keep], code[keep], where[keep]
        code = code * _PRIME + value[at + n - 1]
        if n in GRAMS:
            mixed = (code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            out.append(((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32), where))
    return np.repeat(np.arange(len(raw)), blocks), out


_PRIME = np.uint64(0x100000001B3)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, their blocks and each block's text, for all texts at once."""
    owner, found = _grams(texts)
    return np.concatenate([f for f, _ in found]), np.concatenate([w for _, w in found]), owner


@dataclass
class Model:
    """Bucket table and calibration; ``constant`` for texts without words and where nothing was learned."""

    table: np.ndarray | None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    constant: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        owner, found = _grams(texts)
        total, count = np.zeros(len(owner)), np.zeros(len(owner))
        for ids, where in found:
            edge = np.searchsorted(where, np.arange(len(owner) + 1))
            some = np.flatnonzero(np.diff(edge))
            if len(some):
                total[some] += np.add.reduceat(self.table[ids].astype(np.float64), edge[some])
            count += np.diff(edge)
        mean = total / np.maximum(count, 1)
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, owner, np.where(count > 0, mean + self.bias, -np.inf))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.table is None:
            return np.full(len(texts), self.constant)
        logits = self.logits(texts)
        known = np.isfinite(logits)  # a text without words has none
        score = 1 / (1 + np.exp(-np.clip(self.slope * np.where(known, logits, 0.0) + self.shift, -50, 50)))
        return np.where(known, score, self.constant)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about 1 MB: the arrays hold some 100 bytes per byte."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop] or "") < 1 << 20):
            size += len(texts[stop] or "")
            stop += 1
        yield at, stop
        at = stop


def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets ordered by block, where each block's begin (and the last ends), each block's text. Made
    of some texts at a time, so that only the buckets themselves are held for all."""
    found, count, owner = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in _slices(texts):
        ids, where, own = grams(texts[a:b])
        found.append(ids[np.argsort(where, kind="stable")])
        count.append(np.bincount(where, minlength=len(own)))
        owner.append(own + a)
    return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(count))]), np.concatenate(owner)


def gradients(
    vectors: np.ndarray, count: np.ndarray, soft: np.ndarray, bias: np.ndarray, label: np.ndarray, tilt: np.ndarray
) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The tilted mean cross entropy of blocks, whose n-gram vectors follow each other, ``count`` to a
    block, and its gradients: by each vector of a block (the same for all of them), by softmax and bias."""
    mean = np.add.reduceat(vectors, np.cumsum(count) - count) / count[:, None].astype(np.float32)
    z = mean @ soft + bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    mine = np.arange(len(count)), label
    loss = float(-(tilt * np.log(np.maximum(p[mine], 1e-30))).mean())
    p[mine] -= 1
    g = (p * (tilt / len(count))[:, None]).astype(soft.dtype)
    return loss, (g @ soft.T) / count[:, None].astype(np.float32), mean.T @ g, g.sum(0)


def train(texts: list[str], toxic: np.ndarray, share: float, seed: int = 11) -> Model:
    """Learn from texts and 0/1 labels; ``share`` is that of toxic labels among all."""
    if not len(texts) or toxic.min() == toxic.max():
        return Model(None, constant=share)
    rng = np.random.default_rng(seed)
    apart = rng.permutation(len(texts)) % 4 == 0  # for calibration
    if len(np.unique(toxic[~apart])) < 2 or len(np.unique(toxic[apart])) < 2:
        apart[:] = False
    fit = np.flatnonzero(~apart)
    found, edge, owner = _bags([texts[i] for i in fit])
    n = len(owner)
    label = toxic[fit][owner].astype(np.float64)
    emb = rng.uniform(-1, 1, (BUCKETS, WIDTH)).astype(np.float32) / WIDTH
    soft = np.zeros((WIDTH, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    emb_sum, soft_sum, bias_sum = np.full(BUCKETS, 1e-6, np.float32), np.full((WIDTH, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    use = np.flatnonzero(np.diff(edge) > 0)
    weight = np.ones(n)
    for epoch in range(min(EPOCHS[1], max(EPOCHS[0], VISITS // max(1, n)))):
        if epoch >= 2:  # of a toxic text only the blocks that stand out, and the one that does most
            flat = emb @ (soft[:, 1] - soft[:, 0])
            sums = np.empty(n)
            for a in range(0, n, 1000):
                b = min(n, a + 1000)
                some = np.append(flat[found[edge[a] : edge[b]]], np.float32(0))
                sums[a:b] = np.add.reduceat(some, edge[a:b] - edge[a]) / np.maximum(np.diff(edge[a : b + 1]), 1)
            sums = np.where(np.diff(edge) > 0, sums, 0.0) + bias[1] - bias[0]
            top = np.full(len(fit), -np.inf)
            np.maximum.at(top, owner, sums)
            weight = np.where((label == 0) | (sums >= top[owner]) | (sums > 0), 1.0, 0.0)
        pos, neg = weight[use][label[use] == 1].sum(), weight[use][label[use] == 0].sum()
        tilt = np.where(label == 1, 0.5 / max(pos, 1), 0.5 / max(neg, 1)) * (pos + neg) * weight
        for at in np.array_split(rng.permutation(use), max(1, len(use) // min(BATCH, max(16, n // 100)))):
            at = at[weight[at] > 0]
            if not len(at):
                continue
            count = np.diff(edge)[at]
            ids = found[np.repeat(edge[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            _, g_mean, g_soft, g_bias = gradients(emb[ids], count, soft, bias, label[at].astype(int), tilt[at])
            soft_sum += g_soft**2
            bias_sum += g_bias**2
            soft -= 0.1 * g_soft / np.sqrt(soft_sum)
            bias -= 0.1 * g_bias / np.sqrt(bias_sum)
            seen = np.bincount(ids, minlength=BUCKETS) > 0
            rows = np.flatnonzero(seen)
            back, owner_of = (np.cumsum(seen, dtype=np.int32) - 1)[ids], np.repeat(np.arange(len(at)), count)
            grad = np.stack([np.bincount(back, weights=g_mean[:, j].astype(np.float64)[owner_of]) for j in range(WIDTH)], 1).astype(np.float32)
            emb_sum[rows] += (grad**2).mean(1)
            emb[rows] -= RATE * grad / np.sqrt(emb_sum[rows])[:, None]
    model = Model((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]), constant=share)
    del found, emb, emb_sum
    held = np.flatnonzero(apart) if apart.any() else fit
    kept = [texts[i] for i in held]
    x = np.concatenate([model.logits(kept[a:b]) for a, b in _slices(kept)])
    y, x = toxic[held][np.isfinite(x)].astype(np.float64), x[np.isfinite(x)]
    if not len(y):
        return Model(None, constant=share)
    w = np.where(y == 1, MISS * share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    model.slope, model.shift = _platt(x, y, w)
    return model


def _platt(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic calibration by damped Newton steps, with a little shrinkage of the slope."""
    center, scale = x.mean(), x.std() + 1e-9
    a = np.stack([(x - center) / scale, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (w * (p - y)) + np.array([0.1, 0]) * beta
        hess = (a * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag([0.1, 1e-6])
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    slope = max(beta[0], 1e-3) / scale
    return slope, beta[1] - slope * center


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, seed: int = 11) -> Model:
    """Train on the bounded sample of the labels outside the held-out fold."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id").cast("long")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.filter("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = text.select("doc_id", F.octet_length("text").alias("size")).join(known.filter("toxic in (0, 1)"), "doc_id")
    # of rows with one doc_id the shortest, and of equally long ones the least
    size = materialize(size.groupBy("doc_id", "toxic").agg(F.min("size").alias("size")), "labelled")
    order = (F.xxhash64("doc_id"), "doc_id")
    picks = [size.filter((F.col("toxic") == c) & (F.col("size") <= LONGEST)).orderBy(*order).limit(PER_CLASS) for c in (0, 1)]
    some = {r["toxic"] for r in size.filter(F.col("size") <= LONGEST).select("toxic").distinct().collect()}
    for c in {0, 1} - some:
        found = size.filter(F.col("toxic") == c).orderBy("size", *order).limit(max(1, LONG // LONGEST)).toArrow()
        room = np.cumsum(found.column("size").to_numpy()) <= LONG
        room[:1] = True
        picks[c] = size.sparkSession.createDataFrame(found.filter(pa.array(room)).to_pylist(), size.schema)
    chosen = picks[0].union(picks[1])
    rows = text.withColumn("size", F.octet_length("text")).join(F.broadcast(chosen), ["doc_id", "size"])
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toArrow().sort_by("doc_id")
    return train(rows.column("text").to_pylist(), rows.column("toxic").to_numpy(), share, seed)


def _score_all(model: Model, texts: list[str]) -> np.ndarray:
    """Scores of many texts, some at a time."""
    return np.concatenate([np.empty(0), *(model.scores(texts[a:b]) for a, b in _slices(texts))])


def _apply(model: Model, docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _score_all(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    return _apply(fit(docs, labels), docs).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below one half, all columns kept, scored in place: no join."""
    model, names = fit(docs, labels), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            yield batch.filter(pa.array(_score_all(model, texts) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
