"""Suffix-array dedup of repeated byte strings by a depth-limited, most-significant-digit radix sort.

A suffix matters only through its first ``LENGTH`` bytes, so sorting stops at that depth, and the
groups then left together are exactly the windows that occur more than once. Every pass deals the
suffixes to buckets by their next digit and lets buckets of one suffix go, which after the first
pass is most of them. Digits are fingerprints, since only equality matters at the end:

1. the window's anchor string (64 bytes picked by content, see ``windows``), once per run of
   neighbouring windows that share an anchor;
2. the window's place relative to the anchor in steps of 16, and the bytes that the up to 16
   neighbouring windows of a step span: where two such spans are equal, all their windows repeat;
3. the whole window, in buckets whose spans differ, one of each kind of equal spans standing for
   the others.

Matches never cross texts; a window that repeats within one text counts. Texts travel three times at
most, and only those with a shared anchor after the first time. Equality of spans and windows is
that of 128 fingerprint bits.

Defined results: null text is empty text; texts shorter than a window lose nothing; a row repeated
with a text of a window or more loses all of it; ties need no order; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.blocks import SCHEMA, Sender, changes, deal, receive, words
from symloom.llm.common import materialize, partitions, table, utf8
from symloom.llm.windows import LENGTH, runs

#: Neighbouring windows of one step of the second digit.
STEP = 16
_GROUP, _SPAN = 6, 10  # bytes of the bucket so far and of a span's fingerprint


def _spans(raw: bytes, hashes: np.ndarray, length: int) -> list[tuple[int, int, int, bytes]]:
    """(first window, last window, bucket, record) of every step of the runs whose anchor is shared."""
    out = []
    data = np.frombuffer(raw, np.uint8)
    code, anchor, low, high = runs(data, length)
    for k in np.flatnonzero(np.isin(code, hashes)):
        a, lo, hi, h = int(anchor[k]), int(low[k]), int(high[k]), int(code[k])
        near, far = a - hi, a - lo  # places of the windows' starts before the anchor
        for step in range(near // STEP, far // STEP + 1):
            o0, o1 = max(near, step * STEP), min(far, step * STEP + STEP - 1)
            group = (h ^ (step * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
            span = xxhash.xxh3_128_digest(raw[a - o1 : a - o0 + length], seed=o0 * 256 + o1)
            out.append((a - o1, a - o0, group, (group >> 16).to_bytes(8, "little")[:_GROUP] + span[:_SPAN]))
    return out


def _rows(records: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(records), np.uint8).reshape(-1, width)


def _name(record: bytes) -> int:
    """A record's own signed 64-bit name, to tell a text which of its steps or windows is meant."""
    return int.from_bytes(xxhash.xxh3_64_digest(record), "little", signed=True)


def _names(records: np.ndarray) -> np.ndarray:
    raw = records.tobytes()
    w = records.shape[1]
    return np.array([_name(raw[i : i + w]) for i in range(0, len(raw), w)], dtype=np.int64)


# first digit: anchors


def _send_anchors(parts: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(parts, 8)
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                code, times = np.unique(runs(np.frombuffer(raw, np.uint8), length)[0], return_counts=True)
                code = np.concatenate([code, code[times > 1]])  # twice is enough to be shared
                yield from out.add(code.astype("<u8").view(np.uint8).reshape(-1, 8), key)
        yield from out.flush()

    return run


def _meet_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    records, names = receive(batches, 8)
    code = records.view("<u8").ravel()
    order = np.lexsort((names, code))
    code, names = code[order], names[order]
    group = np.cumsum(changes(code)) - 1
    shared = np.bincount(group)[group] > 1 if len(code) else np.zeros(0, bool)
    keep = shared & changes(code, names)
    yield from _pairs(names[keep], code[keep].view(np.int64))


def _pairs(key: np.ndarray, value: np.ndarray, kind: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(key), 1 << 18):
        b = a + (1 << 18)
        cols = {"key": pa.array(key[a:b]), "value": pa.array(value[a:b])}
        if kind is not None:
            cols["kind"] = pa.array(kind[a:b])
        yield pa.RecordBatch.from_pydict(cols)


# second digit: spans of neighbouring windows


def _send_spans(parts: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(parts, _GROUP + _SPAN)
        for batch in batches:
            for key, raw, hashes in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                steps = _spans(raw, np.array(hashes, np.int64).view(np.uint64), length)
                yield from out.add(_rows([s[3] for s in steps], _GROUP + _SPAN), key)
        yield from out.flush()

    return run


EQUAL, MIXED = 0, 1


def _meet_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """EQUAL: spans that occur more than once. MIXED: spans of buckets with several, one owner of each."""
    records, names = receive(batches, _GROUP + _SPAN)
    if not len(records):
        return
    group, one, two = words(records, 0, _GROUP), words(records, _GROUP, _GROUP + 8), words(records, _GROUP + 8, _GROUP + _SPAN)
    order = np.lexsort((names, two, one, group))
    records, names, group, one, two = records[order], names[order], group[order], one[order], two[order]
    new = changes(group, one, two)
    span = np.cumsum(new) - 1
    repeated = np.bincount(span)[span] > 1
    bucket = np.cumsum(changes(group)) - 1
    several = np.bincount(bucket[new], minlength=bucket[-1] + 1)[bucket] > 1
    equal = np.flatnonzero(repeated & changes(group, one, two, names))
    mixed = np.flatnonzero(several & new)
    at = np.concatenate([equal, mixed])
    kind = np.concatenate([np.full(len(equal), EQUAL, np.int32), np.full(len(mixed), MIXED, np.int32)])
    yield from _pairs(names[at], _names(records[at]), kind)


# third digit: whole windows


def _windows(raw: bytes, steps: list[tuple[int, int, int, bytes]], mixed: set[int], length: int) -> Iterator[tuple[int, bytes]]:
    """(window, record) of the steps that are not settled by their spans."""
    for first, last, _, record in steps:
        if _name(record) in mixed:
            for p in range(first, last + 1):
                yield p, xxhash.xxh3_128_digest(raw[p : p + length])


def _send_windows(parts: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(parts, 16)
        for batch in batches:
            for key, raw, hashes, mixed in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                steps = _spans(raw, np.array(hashes, np.int64).view(np.uint64), length)
                yield from out.add(_rows([r for _, r in _windows(raw, steps, set(mixed), length)], 16), key)
        yield from out.flush()

    return run


def _meet_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    records, names = receive(batches, 16)
    if not len(records):
        return
    one, two = words(records, 0, 8), words(records, 8, 16)
    order = np.lexsort((names, two, one))
    records, names, one, two = records[order], names[order], one[order], two[order]
    new = changes(one, two)
    window = np.cumsum(new) - 1
    keep = (np.bincount(window)[window] > 1) & changes(one, two, names)
    yield from _pairs(names[keep], _names(records[keep]))


def _cut(length: int, bytes_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, sha, raw, hashes, equal, mixed, single in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                equal, mixed, single = set(equal or ()), set(mixed or ()), set(single or ())
                steps = _spans(raw, np.array(hashes, np.int64).view(np.uint64), length)
                depth = np.zeros(len(raw) + 1, np.int32)
                rest = []
                for step in steps:
                    if _name(step[3]) in equal:
                        depth[step[0]] += 1
                        depth[step[1] + length] -= 1
                    else:
                        rest.append(step)
                for p, record in _windows(raw, rest, mixed, length):
                    if _name(record) in single:
                        depth[p] += 1
                        depth[p + length] -= 1
                gone = np.cumsum(depth[:-1]) > 0
                edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((key, sha, int(gone.sum()), np.stack([starts, stops], 1).tolist(), kept, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 6
            arrays = {
                "key": pa.array(cols[0], pa.int64()),
                "sha": pa.array(cols[1], pa.string()),
                "n_removed": pa.array(cols[2], pa.int64()),
                "n_spans": pa.array([len(s) for s in cols[3]], pa.int64()),
                "kept_sha256": pa.array(cols[5], pa.string()),
            }
            if bytes_too:
                arrays |= {"spans": pa.array(cols[3], pa.list_(pa.list_(pa.int64()))), "kept": pa.array(cols[4], pa.binary())}
            yield pa.RecordBatch.from_pydict(arrays)

    return run


CUT = "key long, sha string, n_removed long, n_spans long, kept_sha256 string"


def repeats(docs: DataFrame, length: int = LENGTH, bytes_too: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; with ``bytes_too`` also the
    removed ``spans`` and the ``kept`` bytes (both null where nothing is removed)."""
    parts = partitions(docs.sparkSession)
    raw = utf8()
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw"), F.xxhash64(raw).alias("key"), F.sha2(raw, 256).alias("sha"), F.octet_length(raw).cast("long").alias("n_bytes")
    )
    sent = base.select("key", "raw").mapInArrow(_send_anchors(parts, length), SCHEMA)
    shared = deal(sent, parts).mapInArrow(_meet_anchors, "key long, value long")
    shared = shared.groupBy("key").agg(F.collect_list("value").alias("hashes"))
    texts = materialize(base.join(shared, "key").select("key", "sha", "raw", "hashes"), "texts")
    sent = texts.select("key", "raw", "hashes").mapInArrow(_send_spans(parts, length), SCHEMA)
    met = materialize(deal(sent, parts).mapInArrow(_meet_spans, "key long, value long, kind int"), "spans")
    named = lambda k: F.collect_list(F.when(F.col("kind") == k, F.col("value")))
    state = met.groupBy("key").agg(named(EQUAL).alias("equal"), named(MIXED).alias("mixed"))
    todo = texts.join(state.filter(F.size("mixed") > 0).select("key", "mixed"), "key").select("key", "raw", "hashes", "mixed")
    sent = todo.mapInArrow(_send_windows(parts, length), SCHEMA)
    single = deal(sent, parts).mapInArrow(_meet_windows, "key long, value long").withColumn("kind", F.lit(2))
    single = materialize(single, "windows")
    state = (
        met.unionByName(single).groupBy("key").agg(named(EQUAL).alias("equal"), named(MIXED).alias("mixed"), named(2).alias("single"))
    )
    rows = texts.join(state, "key").select("key", "sha", "raw", "hashes", "equal", "mixed", "single")
    cut = rows.mapInArrow(_cut(length, bytes_too), CUT + (", spans array<array<long>>, kept binary" if bytes_too else ""))
    cut = cut.dropDuplicates(["key", "sha"])
    more = ["spans", "kept"] if bytes_too else []
    return base.drop("raw").join(cut, ["key", "sha"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        *more,
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
