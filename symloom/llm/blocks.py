"""Fixed-width records that travel in packed blocks, one per map task and target partition.

A record is some bytes, the first four of which are evenly spread and choose its partition; its
owner is a signed 64-bit name. Packed, a record costs its bytes and two or four for the owner's
place in the block's list of names, and both sides handle whole arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "part int, records binary, owner binary, names binary"
#: Bytes of records that a map task holds before it sends its blocks on.
HELD = 32 << 20


class Sender:
    """Gathers records by owner and gives them out as blocks."""

    def __init__(self, parts: int, width: int, held: int = HELD) -> None:
        self.parts, self.width, self.most = parts, width, held
        self.records: list[np.ndarray] = []
        self.names: list[int] = []
        self.size = 0

    def add(self, records: np.ndarray, name: int) -> Iterator[pa.RecordBatch]:
        """``records``: bytes in rows of ``width``."""
        if len(records):
            self.records.append(records)
            self.names.append(name)
            self.size += records.nbytes
        if self.size >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.names:
            return
        records, names = np.concatenate(self.records), np.array(self.names, dtype=np.int64)
        owner = np.repeat(np.arange(len(names), dtype=np.uint32), [len(r) for r in self.records])
        self.records, self.names, self.size = [], [], 0
        lead = np.ascontiguousarray(records[:, :4]).view("<u4").ravel().astype(np.uint64)
        target = ((lead * np.uint64(self.parts)) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(target, kind="stable")
        records, owner, target = records[order], owner[order], target[order]
        cut = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1], [True]]))
        rows = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            used, local = np.unique(owner[a:b], return_inverse=True)
            small = local.astype("<u4" if len(used) > 65535 else "<u2")
            rows.append((int(target[a]), records[a:b].tobytes(), small.tobytes(), names[used].tobytes()))
        for k in range(0, len(rows), 4096):
            some = rows[k : k + 4096]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in some], pa.int32()), *(pa.array([r[j] for r in some], pa.binary()) for j in (1, 2, 3))],
                names=["part", "records", "owner", "names"],
            )


def deal(blocks: DataFrame, parts: int) -> DataFrame:
    """Every block to its partition."""
    return blocks.repartitionById(parts, F.col("part"))


def receive(batches: Iterator[pa.RecordBatch], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All records of a partition and their owners' names."""
    records, names = [np.zeros((0, width), np.uint8)], [np.zeros(0, np.int64)]
    for batch in batches:
        for raw, owner, known in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            known = np.frombuffer(known, np.int64)
            records.append(np.frombuffer(raw, np.uint8).reshape(-1, width))
            names.append(known[np.frombuffer(owner, "<u4" if len(known) > 65535 else "<u2")])
    return np.concatenate(records), np.concatenate(names)


def words(records: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Up to eight bytes of every record as a number."""
    wide = np.zeros((len(records), 8), np.uint8)
    wide[:, : stop - start] = records[:, start:stop]
    return wide.view("<u8").ravel()


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before; the first does."""
    n = len(columns[0])
    out = np.zeros(n, dtype=bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out
