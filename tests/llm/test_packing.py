import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from symloom.llm import packing


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, length string, rank int, salt int")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.vocabulary(packing.TOKENIZER))


def test_fast_ids_equal_the_tokenizers(tokenizer):
    encode = packing.encoder(packing.vocabulary(packing.TOKENIZER), packing.vocabulary(packing.RANKS))
    rng = random.Random(3)
    pool = [chr(c) for c in range(0x2FFF)] + ["  ", "\n", " ", "'s", "'ll", "<|endoftext|>", "　", "é", "\U0001f600"] * 60
    for _ in range(1500):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
        assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_best_fit_is_valid_and_tight():
    rng = random.Random(5)
    counts: dict[int, int] = {}
    for _ in range(5000):
        n = rng.choice([1024, rng.randint(1, 1024), rng.randint(1, 200), 600])
        counts[n] = counts.get(n, 0) + 1
    slots, used = packing.best_fit(counts)
    fill: dict[int, list] = {}
    placed = dict.fromkeys(counts, 0)
    slots.sort()
    for k, (length, rank, first, per, at) in enumerate(slots):
        assert rank == placed[length]
        upto = slots[k + 1][1] if k + 1 < len(slots) and slots[k + 1][0] == length else counts[length]
        placed[length] = upto
        for r in range(upto - rank):
            fill.setdefault(first + r // per, []).append((at + r % per * length, length))
    assert placed == counts and set(fill) == set(range(used))
    for parts in fill.values():
        place = 0
        for at, length in sorted(parts):
            assert at == place
            place += length
        assert place <= 1024
    # first-fit decreasing, one by one, is never beaten by more than a little
    bins: list[int] = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        best = min((b for b in range(len(bins)) if bins[b] >= n), key=lambda b: bins[b], default=None)
        if best is None:
            bins.append(1024 - n)
        else:
            bins[best] -= n
    assert used <= len(bins)


def test_pack_against_tokenizer(spark, tokenizer):
    long = "word " * 3000 + "end"
    rows = [(1, None, "x", 1, 2), (2, "", None, None, None), (3, long, "y", 3, 4), (4, "a b", None, 0, 0), (4, "a b", None, 0, 0)]
    rows += [(k, f"text number {k}", "", 0, 0) for k in range(5, 60)]
    out = packing.pack(_docs(spark, rows)).toPandas()
    text = {r[0]: r[1] or "" for r in rows}
    place: dict[int, list] = {}
    for r in out.itertuples():
        ids = [*tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids, 2]
        part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
        assert len(part) == 4 * r.length and zlib.crc32(part) == r.ids_crc32
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in place.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 1024
    whole = out.groupby("doc_id").length.sum().to_dict()
    assert whole[1] == whole[2] == 1 and whole[4] == 2 * (1 + len(tokenizer.encode("a b").ids))
    three = out[out.doc_id == 3].sort_values("piece")
    assert list(three.length[1:]) == [1024] * (len(three) - 1) and three.length.iloc[0] <= 1024
    assert len(place) == -(-out.length.sum() // 1024)


def test_empty_table(spark):
    assert packing.pack(_docs(spark, []).withColumn("extra", F.lit(1))).count() == 0
