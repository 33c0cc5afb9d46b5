"""The pipeline's stages on a small corpus, each against its own input."""

import random
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_ops import _edits, classes
from test_scale import _copies
from tokenizers import Tokenizer

from symloom.llm import mixing, packing, toxicity


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for k in range(300):
        w = [word() for _ in range(50)]
        if k % 5 == 0:
            for _ in range(5):
                w[rng.randrange(50)] = "dreadfulness"
        rows.append((k, " ".join(w[:25]) + "\n" + " ".join(w[25:]), "en", f"s{k % 4}", 0))
        labels.append((k, 1, int(k % 5 == 0)))
    shared = " ".join(word() for _ in range(12))
    copy = " ".join(word() for _ in range(200))
    rows += [(400 + k, shared + "\n" + word() + " " + word(), "en", "s1", 0) for k in range(5)]
    rows += [(500 + k, copy + "\n" + copy.replace(" ", "  ") + f" {k}", "en", None, 0) for k in range(4)]
    rows += [(600, None, None, None, None), (601, "", "en", "s9", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "mix_sources", "best_fit_packing"]
    kept = {r.doc_id for r in seen["toxicity"]}
    assert len([k for k in range(300) if (k in kept) == (k % 5 != 0)]) >= 295 and {400, 500, 600, 601} <= kept
    lines = {r.doc_id: r.text for r in seen["line_dedup"]}
    assert lines.keys() == kept and lines[400].startswith(shared) and all(shared not in lines[400 + k] for k in range(1, 5))
    groups = {r.doc_id for r in seen["jaccard_join"]}
    assert groups <= kept and {600, 601, 500} <= groups
    mixed = {r.doc_id for r in seen["mix_sources"]}
    assert mixed <= groups
    packed = spark.read.parquet(f"{tmp_path}/best_fit_packing")
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.filter("n <> end OR n > 1024").count() == 0
    assert packed.filter("piece = 0").count() == len(seen["mix_sources"])


def test_stages_against_brute_force(spark, tmp_path):
    """Every stage's rows from its own input, by plain loops (toxicity: by its own scores)."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    some = lambda n: " ".join(word() for _ in range(n))
    line, group, rows = some(9), some(80), []
    for k in range(90):
        bad = " dreadfulness" * (4 * (k % 4 == 0))
        rows.append((k, some(rng.choice([3, 12, 30])) + bad + "\n" + some(8), "en", f"s{k % 3}" if k % 7 else None, k))
    rows += [(100, line + "\n" + some(20), "en", "s0", 0), (101, line[:9] + "x" + line[9:] + "\n" + some(20), "en", "s1", 0)]
    rows += [(102, "Short.\n" + some(9) + "\nShort.", "en", "s1", 0), (103, "Short.", "en", "s2", 0)]
    # copies line by line apart by more than two edits, though near as documents
    rows += [(110 + k, group + f" {k * 1111111:07d} {some(1)}zz" * (1 + k % 2), "en", "s2", 0) for k in range(5)]
    rows += [(120, None, None, None, None), (121, "", "en", "s9", 0), (122, some(1500), "en", "s0", 0)]
    known = [(k, 1, int(k % 4 == 0)) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    told = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, told[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        told.append(spark.read.parquet(f"{tmp_path}/{name}"))
    first, clean, short, apart, mixed = ([(r.doc_id, r.text, r.source) for r in df.collect()] for df in told[:5])

    scores = toxicity.toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    rejected = {r.doc_id for r in scores if r.predicted}
    assert rejected and sorted(clean, key=str) == sorted((r for r in first if r[0] not in rejected), key=str)
    assert _without_lines(clean) == {d: t for d, t, _ in short}
    assert sorted(d for d, _, _ in apart) == sorted(d for d, n, least in classes([r[:2] for r in short]) if n == 0 or d == least)

    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in apart}
    taken = Counter(d for d, _, _ in mixed)
    goal = {r.source: r.target for r in mixing.mix(told[3]).collect()}
    for s in {s for _, _, s in apart}:
        mine = Counter(size[d] for d, _, x in apart if x == s and size[d])
        got: dict = {}
        for d, _, x in apart:
            if x == s and size[d]:
                got[size[d]] = got.get(size[d], 0) + taken[d]
        assert got == (_copies(sorted(mine.items()), goal[s]) if mine else {})

    tokens = Tokenizer.from_file(packing.vocabulary(packing.TOKENIZER))
    length = {d: len(tokens.encode(t or "", add_special_tokens=False).ids) + 1 for d, t, _ in mixed}
    pieces = told[5].collect()
    packed: Counter = Counter()
    for r in pieces:
        packed[r.doc_id] += r.length
    assert packed == Counter({d: n * length[d] for d, n in taken.items()})
    full: dict = {}
    for r in sorted(pieces, key=lambda r: r.offset):
        assert r.offset == full.get(r.sequence_id, 0)
        full[r.sequence_id] = r.offset + r.length
    assert max(full.values()) <= 1024 and len(full) <= 1 + 11 * sum(full.values()) // (9 * 1024)


def _without_lines(rows):
    """Texts without lines that repeat an earlier one, or, from 24 characters, are within two edits of one."""
    before, out = [], {}
    for d, text, _ in sorted(rows, key=lambda r: r[0]):
        kept = []
        for s in (text or "").split("\n"):
            bag = Counter(s)
            near = lambda o, b: len(o) >= 24 and ((bag - b) + (b - bag)).total() <= 4 and _edits(o, s) <= 2
            gone = s and any(o == s or (len(s) >= 24 and near(o, b)) for o, b in before)
            if not gone:
                kept.append(s)
            before.append((s, bag))
        out[d] = None if text is None else "\n".join(kept)
    return out
