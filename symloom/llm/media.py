"""Media columns, telephony audio.

A text's bytes, zero-padded to a positive multiple of 64, are kept losslessly as the 8-bit samples
of a mono G.711 mu-law WAVE file. What is read back is decoded three ways (mu-law and A-law by
256-entry lookup tables, IMA ADPCM by numpy across all 64-byte blocks of a batch at once),
resampled from 8 kHz to 16 kHz and stored as linear PCM.

Defined results: null text is empty text; empty text is 64 zero bytes; equal texts give equal rows;
repeated rows stay repeated; an empty table gives an empty table; columns of the input other than
``doc_id`` and ``text`` are not read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.common import table, utf8

BLOCK = 64
RATE = 8000
MULAW = 7


def _mulaw_table() -> np.ndarray:
    """ITU-T G.711 mu-law expansion of every code to 16-bit linear."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    """ITU-T G.711 A-law expansion of every code to 16-bit linear."""
    code = np.arange(256) ^ 0x55
    step, size = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(step == 0, size + 8, size + 0x108 << np.maximum(step - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = _mulaw_table(), _alaw_table()

# Fixed values of the IMA ADPCM standard: quantiser step sizes and index changes.
IMA_STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45,
        50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
        337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
        2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899,
        15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    dtype=np.int32,
)
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def _ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each (step index, nibble): the signed difference and the next step index."""
    nibble = np.arange(16)
    step = IMA_STEPS[:, None]
    size = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
    nxt = np.clip(np.arange(len(IMA_STEPS))[:, None] + IMA_INDEX[nibble & 7], 0, len(IMA_STEPS) - 1)
    return np.where(nibble & 8, -size, size).astype(np.int32).ravel(), (nxt * 16).astype(np.int32).ravel()


IMA_DELTA, IMA_NEXT = _ima_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM blocks (n, size) of bytes -> samples (n, 1 + 2 * (size - 4)): one numpy step per
    sample position, all blocks at once. A block starts with its first sample (int16), the step
    index (clipped to the table) and an unused byte; low nibbles come first."""
    n, size = blocks.shape
    out = np.empty((1 + 2 * (size - 4), n), dtype=np.int16)
    sample = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    state = np.minimum(blocks[:, 2], len(IMA_STEPS) - 1).astype(np.int32) * 16
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out[0] = sample
    for k in range(2 * (size - 4)):
        at = state + ((data[k >> 1] >> 4) if k & 1 else (data[k >> 1] & 15))
        sample = np.clip(sample + IMA_DELTA[at], -32768, 32767)
        state = IMA_NEXT[at]
        out[k + 1] = sample
    return np.ascontiguousarray(out.T)


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """8 kHz to 16 kHz by linear interpolation; the last sample is held."""
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[::2] = pcm
    out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
    out[-1:] = pcm[-1:]
    return out


def write_wave(samples: bytes, tag: int = MULAW, rate: int = RATE, bits: int = 8) -> bytes:
    """A mono RIFF/WAVE file; non-PCM tags get the extension size and a fact chunk."""
    wide = bits // 8
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * wide, wide, bits) + (b"" if tag == 1 else b"\0\0")
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt
    if tag != 1:
        body += b"fact" + struct.pack("<II", 4, len(samples) // wide)
    body += b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> bytes:
    """The data chunk of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at = 12
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def pad(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % BLOCK if raw else BLOCK)


SCHEMA = "doc_id long, n_bytes long, media binary, payload binary, pcm binary, feature string"


def _telephony(raws: list[bytes]) -> list[tuple[int, bytes, bytes, bytes, str]]:
    media = [write_wave(pad(r)) for r in raws]
    back = [read_wave(m) for m in media]
    adpcm = decode_adpcm(np.frombuffer(b"".join(back), np.uint8).reshape(-1, BLOCK))
    out, block = [], 0
    for raw, m, payload in zip(raws, media, back, strict=True):
        codes = np.frombuffer(payload, np.uint8)
        mulaw, alaw = MULAW_PCM[codes], ALAW_PCM[codes]
        pcm = resample_double(mulaw)
        ima = adpcm[block : block + len(payload) // BLOCK].ravel()
        block += len(payload) // BLOCK
        flips = int(np.count_nonzero((mulaw[1:] < 0) != (mulaw[:-1] < 0)))
        feature = (
            f"n={len(pcm)};ulaw={zlib.crc32(pcm.tobytes()):08x};alaw={zlib.crc32(alaw.tobytes()):08x};"
            f"adpcm={zlib.crc32(ima.tobytes()):08x};peak={int(np.abs(mulaw.astype(np.int32)).max())};"
            f"level={int(np.abs(mulaw.astype(np.int64)).sum()) // len(mulaw)};flips={flips}"
        )
        out.append((len(raw), m, payload, pcm.tobytes(), feature))
    return out


def _slices(raws: list[bytes], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` bytes each, so decoding memory stays bounded."""
    start = total = 0
    for k, raw in enumerate(raws):
        total += len(raw) + BLOCK
        if total >= most:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(raws):
        yield start, len(raws)


def _batches(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, raws = batch.column(0), batch.column(1).to_pylist()
        for a, b in _slices(raws):
            rows = _telephony(raws[a:b])
            if digest:
                cols = {
                    "n_bytes": pa.array([r[0] for r in rows], pa.int64()),
                    "payload_bytes": pa.array([len(r[2]) for r in rows], pa.int64()),
                    "payload_sha256": pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows]),
                    "tail_crc32": pa.array([zlib.crc32(r[2][-BLOCK:]) for r in rows], pa.int64()),
                    "media_bytes": pa.array([len(r[1]) for r in rows], pa.int64()),
                    "media_sha256": pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows]),
                    "feature": pa.array([r[4] for r in rows]),
                }
            else:
                cols = {
                    "n_bytes": pa.array([r[0] for r in rows], pa.int64()),
                    "media": pa.array([r[1] for r in rows], pa.binary()),
                    "payload": pa.array([r[2] for r in rows], pa.binary()),
                    "pcm": pa.array([r[3] for r in rows], pa.binary()),
                    "feature": pa.array([r[4] for r in rows]),
                }
            yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(a, b - a), **cols})


def telephony(docs: DataFrame) -> DataFrame:
    """One row per document with the stored file, its payload read back and the resampled PCM."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("raw"))
    return src.mapInArrow(lambda it: _batches(it, False), SCHEMA)


DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def telephony_digest(docs: DataFrame) -> DataFrame:
    """As ``telephony``, with digests in place of the bytes (they never leave the Python worker)."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("raw"))
    return src.mapInArrow(lambda it: _batches(it, True), DIGEST)


def op10_media_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony_digest(table(spark, sf_dir, "documents"))
