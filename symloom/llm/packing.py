"""Best-fit packing by length histogram.

Texts are tokenized and end-marked, documents longer than a sequence are cut, and only the counts
of piece lengths (at most one per possible length) reach the driver. Best-fit decreasing runs over
those counts: a step places many equal pieces at once and leaves a slot range per length. Pieces
then take slots by joining on their rank within their length. Ranks come from salted sub-groups
with running offsets, so no length, however common, meets in one task.

Defined results: null and empty texts are one piece holding the end mark alone; repeated rows are
packed as often as they occur; ties in rank fall to (doc_id, piece); an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.llm.common import materialize, partitions, table

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SEQUENCE = 1024
END = 2
#: The byte-level pattern with possessive repeats: the same tokens, found without backtracking.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of the JSON file's tokenizer. Its vocabulary as ranks gives the same ids some four times
    as fast; only a text that holds an added token's string needs the tokenizer itself."""

    def __init__(self, path: str, ranks: str) -> None:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.path, self.full = path, None
        with open(path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if any(t in text for t in self.added):
            if self.full is None:
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_file(self.path)
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@functools.cache
def encoder(path: str, ranks: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path, ranks)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, ranks: str | None = None, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """Pieces of at most ``sequence`` tokens; of a longer document the first may be shorter."""
    path, ranks = path or vocabulary(TOKENIZER), ranks or vocabulary(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, mark = encoder(path, ranks), np.array([end], "<u4").tobytes()
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + mark
                n = len(ids) // 4
                start, k = 0, 0
                stop = n % sequence or sequence
                while start < n:
                    out.append((doc, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, stop, k = stop, stop + sequence, k + 1
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return src.mapInArrow(run, PIECES)


Slots = list[tuple[int, int, int, int, int]]


def best_fit(counts: dict[int, int], sequence: int = SEQUENCE) -> tuple[Slots, int]:
    """Best-fit decreasing over length counts.

    Returns slot ranges (length, first rank, first sequence, pieces per sequence, offset) and the
    number of sequences. Rank r of a range at first rank f is in sequence ``first + (r - f) // per``
    at ``offset + (r - f) % per * length``.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> [(first sequence, sequences)]
    slots: Slots = []
    used = 0

    def place(length: int, rank: int, first: int, n: int, free: int, left: int) -> tuple[int, list[tuple[int, int, int]]]:
        """Fill up to n sequences with ``free`` tokens each; gives pieces placed and what room remains."""
        per = free // length
        full = min(n, left // per)
        rest = min(left - full * per, per) if full < n else 0
        after = []
        if full:
            slots.append((length, rank, first, per, sequence - free))
            after.append((free - per * length, first, full))
        if rest:
            slots.append((length, rank + full * per, first + full, rest, sequence - free))
            after.append((free - rest * length, first + full, 1))
        if n > full + bool(rest):
            after.append((free, first + full + bool(rest), n - full - bool(rest)))
        return full * per + rest, after

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for free in sorted(f for f in room if f >= length):
            groups, keep = room.pop(free), []
            for k, (first, n) in enumerate(groups):
                if not left:
                    keep += groups[k:]
                    break
                done, after = place(length, rank, first, n, free, left)
                left, rank = left - done, rank + done
                for f, a, m in after:
                    if f == free:
                        keep.append((a, m))
                    elif f:
                        room.setdefault(f, []).append((a, m))
            if keep:
                room.setdefault(free, []).extend(keep)
            if not left:
                break
        if left:
            n = -(-left // (sequence // length))
            _, after = place(length, rank, used, n, sequence, left)
            for f, a, m in after:
                if f:
                    room.setdefault(f, []).append((a, m))
            used += n
    return slots, used


def ranked(rows: DataFrame) -> DataFrame:
    """``rank`` from 0 within each length, through salted sub-groups and their running offsets."""
    salts = 4 * partitions(rows.sparkSession)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    offsets = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    return rows.join(offsets, ["length", "salt"]).withColumn("rank", F.col("base") + F.row_number().over(within) - 1)


PACKED = f"{PIECES}, sequence_id long, offset long"


def pack(docs: DataFrame, path: str | None = None, ranks: str | None = None, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """Every piece with its sequence and its place there."""
    rows = materialize(pieces(docs, path, ranks, sequence, end), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = best_fit(counts, sequence)
    plan = np.array(sorted(slots) or np.empty((0, 5)), dtype=np.int64)
    shift = 50
    keys = (plan[:, 0] << shift) + plan[:, 1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            if not len(length):
                continue
            slot = plan[np.searchsorted(keys, (length << shift) + rank, side="right") - 1]
            step = rank - slot[:, 1]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(slot[:, 2] + step // slot[:, 3]), pa.array(slot[:, 4] + step % slot[:, 3] * length)],
                names=[*names, "sequence_id", "offset"],
            )

    return ranked(rows).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(assign, PACKED)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
