"""Small fixtures for every operator: nulls, empty and long texts, ties, repeated rows, empty tables,
extra columns with clashing names; results against brute force."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from symloom.llm import jaccard, lines, media, mixing, secrets, sketches, substrings, topk, toxicity, trigrams
from symloom.llm.components import components
from symloom.llm.shingles import shingle_sets

#: Columns that the operators use inside, to clash with.
EXTRA = "n_shingles long, size long, source string, key long, raw binary, h1 long, rank int"


def docs(spark, rows):
    rows = [(d, t, None, None, f"s{i % 3}" if i % 5 else None, i, b"x", None, 1) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "One TWO"), (5, "x" * 5000)]
    base = words(rng, 120).split()
    for k in range(30):  # near copies of one text, of growing distance
        w = base.copy()
        for _ in range(k // 3):
            w[rng.randrange(len(w))] = "zz" + str(rng.random())
        rows.append((10 + k, " ".join(w)))
    passage = words(rng, 90)
    for k in range(12):
        rows.append((50 + k, words(rng, 60) + "\n" + passage + "\n" + words(rng, 40)))
    rows += [(70, words(rng, 4000)), (71, "ab " * 300), (72, "ab " * 299), (10, " ".join(base)), (90, " ".join(base).upper())]
    return rows


# media


def test_media_round_trip(spark, corpus):
    rows = {}
    for r in media.telephony(docs(spark, corpus)).collect():
        rows.setdefault(r.doc_id, r)
    for d, t in corpus:
        raw, r = (t or "").encode(), rows[d]
        if d == 10:
            continue
        assert bytes(r.payload) == media.pad(raw) == media.read_wave(bytes(r.media)) and len(r.payload) % 64 == 0 and len(r.payload)
        assert r.n_bytes == len(raw) and len(r.pcm) == 4 * len(r.payload)
    for r in media.telephony_digest(docs(spark, corpus)).collect():
        full = rows[r.doc_id]
        if r.doc_id != 10:
            assert r.payload_sha256 == hashlib.sha256(bytes(full.payload)).hexdigest() and r.feature == full.feature
            assert r.tail_crc32 == zlib.crc32(bytes(full.payload)[-64:]) and r.media_bytes == len(full.media)
    assert media.telephony_digest(docs(spark, [])).count() == 0


def test_codecs():
    assert media.MULAW_PCM[0xFF] == 0 and media.MULAW_PCM[0x00] == -32124 and media.MULAW_PCM[0x80] == 32124
    assert media.ALAW_PCM[0xD5] == 8 and media.ALAW_PCM[0x55] == -8 and media.ALAW_PCM.max() == 32256

    def slow(block):
        sample, index = struct.unpack_from("<hB", block)
        index, out = min(index, 88), [sample]
        for byte in block[4:]:
            for nibble in (byte & 15, byte >> 4):
                step = int(media.IMA_STEPS[index])
                diff = step >> 3
                diff += step if nibble & 4 else 0
                diff += step >> 1 if nibble & 2 else 0
                diff += step >> 2 if nibble & 1 else 0
                sample = max(-32768, min(32767, sample - diff if nibble & 8 else sample + diff))
                index = max(0, min(88, index + int(media.IMA_INDEX[nibble & 7])))
                out.append(sample)
        return out

    rng = np.random.default_rng(2)
    blocks = rng.integers(0, 256, (20, 64), dtype=np.uint8)
    assert media.decode_adpcm(blocks).tolist() == [slow(b.tobytes()) for b in blocks]
    assert media.resample_double(np.array([0, 10, -10], np.int16)).tolist() == [0, 5, 10, 0, -10, -10]


# substrings


def cut(rows, length):
    count = Counter()
    for _, t in rows:
        raw = (t or "").encode()
        count.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if count[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((d, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_are_the_repeated_windows(spark, corpus):
    got = substrings.repeats(docs(spark, corpus), bytes_too=True).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == cut(corpus, 200)
    assert any(0 < r.n_removed < r.n_bytes for r in got)
    assert substrings.repeats(docs(spark, [])).count() == 0


def test_long_texts_are_cut_into_overlapping_parts(monkeypatch):
    from symloom.llm import windows

    data = np.random.default_rng(1).integers(0, 4, 5000).astype(np.uint8)
    whole = windows.runs(data)
    monkeypatch.setattr(windows, "_PLACE", 10)
    monkeypatch.setattr(windows, "_MASK", np.uint64(1023))
    parts = windows.runs(data)

    def anchors(r):
        return {p: int(a) for a, lo, hi in zip(*r[1:], strict=True) for p in range(lo, hi + 1)}

    same = [p for p in range(4801) if anchors(whole)[p] == anchors(parts)[p]]
    assert set(anchors(parts)) == set(range(4801)) and len(same) > 4000


# Jaccard join


def classes(rows):
    sets = []
    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(table))
        sets.append((d, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("wide", [4096, 8])
def test_classes_against_all_pairs(spark, corpus, monkeypatch, wide):
    monkeypatch.setattr(jaccard, "WIDE", wide)
    rows = corpus + [(200 + k, t) for k, (_, t) in enumerate(corpus[6:20])]
    got = jaccard.classes(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == classes(rows)
    assert jaccard.classes(docs(spark, [])).count() == 0


@pytest.mark.parametrize("wide", [4096, 8])
def test_links_are_all_linked_pairs(spark, corpus, monkeypatch, wide):
    monkeypatch.setattr(jaccard, "WIDE", wide)
    base = corpus[6][1].split()
    rows = [(k, " ".join(w if i not in (3 * k, 7 * (k % 9)) else "zz" for i, w in enumerate(base))) for k in range(30)] + corpus[6:16] + corpus[6:8]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.lower().split() for _, t in rows)]
    distinct = list(dict.fromkeys(sets))
    near = {a: sum(a != b and 100 * len(a & b) >= 80 * len(a | b) for b in distinct) for a in distinct}
    found, counts = jaccard.links(docs(spark, rows))
    assert sum(near.values()) > 6 * len(near) and found.count() == found.distinct().count() == sum(near.values()) // 2
    assert sorted((r.doc_id, r.n_links) for r in counts.collect()) == sorted((d, near[s]) for (d, _), s in zip(rows, sets, strict=True))
    assert [x.count() for x in jaccard.links(docs(spark, []))] == [0, 0]


def test_representatives(spark, corpus):
    kept = jaccard.representatives(docs(spark, corpus))
    want = {(d, c) for d, n, c in classes(corpus)}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got) == sorted([d for d, c in want if d == c]) and kept.columns == docs(spark, []).columns


def test_one_representative_under_repeated_and_null_ids(spark):
    base = [[f"{c}{i}" for i in range(60)] for c in "pqr"]
    rows = [(5, " ".join(base[0][:k])) for k in (58, 59, 60)] + [(None, " ".join(base[1][:k])) for k in (58, 59, 60)]
    rows += [(5, " ".join(base[2])), (6, " ".join(base[2][:58])), (None, " ".join(base[2][:59])), (None, None), (None, "")]
    got = [(r.doc_id, (r.text or "")[:1]) for r in jaccard.representatives(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(5, "p"), (5, "r"), (None, "q"), (None, ""), (None, "")], key=str)


def test_signatures_meet_for_every_link():
    rng = np.random.default_rng(3)
    bands = jaccard.Bands()
    for n in (1, 2, 4, 5, 9, 17, 40, 146, 300):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            most = (2 * n) // 9
            drop = int(rng.integers(0, most + 1))
            add = int(rng.integers(0, most - drop + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
                often = jaccard.Frequent(np.sort(rng.permutation(a)[: n // 2]), np.full(n // 2, 50.0))
                for f in (jaccard.NONE, often):
                    assert np.intersect1d(jaccard.signatures(a, bands, f), jaccard.signatures(b, bands, f)).size
            x, y = sketches.same_width([sketches.sketch(a), sketches.sketch(b)]) if len(b) else (None, None)
            if x is not None:
                assert sketches.least_difference(x, y[None])[0] <= len(a) + len(b) - 2 * both


def test_shingles():
    a, b, c, d, e = shingle_sets([b"a b c d e f", b"A  b\tc\nd e F", b"a b", b"", b"b a"])
    assert a.tolist() == b.tolist() and len(a) == 2 and len(c) == 1 and not len(d) and c[0] != e[0]


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 14), (14, 10), (5, 5)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(2, 1), (3, 1), (11, 10), (12, 10), (13, 10), (14, 10)}


# lines


def test_lines(spark):
    rng = random.Random(4)
    a = "".join(rng.choice("abcde ü") for _ in range(60))
    b = a[:20] + "X" + a[20:50] + a[51:]  # two edits
    c = a[:10] + "XYZ" + a[13:]  # three or fewer, all at one place
    rows = [(3, a + "\n" + b), (1, "short\nshort\n" + a), (2, c + "\n\n\n" + a), (4, None), (5, ""), (6, "q" * 9000 + "\n" + "q" * 9001), (1, "short\nshort\n" + a)]
    near = lambda x, y: _edits(x, y) <= 2
    order = sorted({(d, t) for d, t in rows if t}, key=lambda r: r[0])
    first: dict[str, tuple] = {}
    for d, t in order:
        for p, s in enumerate(t.split("\n")):
            if len(s) >= 24:
                first.setdefault(s, (d, p))
    want = {}
    for d, t in order:
        want[d] = ",".join(
            str(p)
            for p, s in enumerate(t.split("\n"))
            if len(s) >= 24 and (first[s] != (d, p) or any(first[o] < first[s] and near(o, s) for o in first))
        )
    got = {r.doc_id: r.removed for r in lines.report(docs(spark, rows)).collect()}
    assert {d: got[d] for d in want} == want and got[4] == got[5] == ""
    kept = lines.dedup_lines(docs(spark, rows))
    out = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == docs(spark, []).columns and kept.count() == len(rows)
    assert out[1] == "short\nshort\n" + a and out[4] is None and out[5] == "" and out[6] == "q" * 9000
    assert lines.report(docs(spark, [])).count() == 0


def test_short_lines_repeat_exactly(spark):
    rows = [(2, "All rights reserved.\nAll rights reserved?"), (1, "é\n\né\nAll rights reserved."), (3, "\n\né" + "x" * 30), (4, "é"), (5, None)]
    got = {r.doc_id: (r.removed, r.n_near) for r in lines.report(docs(spark, rows), exact=1).collect()}
    assert got == {1: ("2", 0), 2: ("0", 0), 3: ("", 0), 4: ("0", 0), 5: ("", 0)}
    out = {r.doc_id: r.text for r in lines.dedup_lines(docs(spark, rows), exact=1).collect()}
    assert out == {1: "é\n\nAll rights reserved.", 2: "All rights reserved?", 3: rows[2][1], 4: "", 5: None}
    assert {r.n_removed for r in lines.report(docs(spark, rows)).collect()} == {0}


def test_pipeline_stage_removes_short_repeats(spark):
    import corpus_pipeline

    rows = docs(spark, [(1, "All rights reserved.\na"), (2, "b\nAll rights reserved.")])
    assert {r.doc_id: r.text for r in corpus_pipeline.remove_lines(spark, rows, "").collect()} == {1: "All rights reserved.\na", 2: "b"}


def _edits(a, b):
    if abs(len(a) - len(b)) > 2:
        return 3
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        lo, hi = max(1, i - 3), min(len(b), i + 3)
        new += [99] * (lo - 1)
        for j in range(lo, hi + 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1])))
        row = new + [99] * (len(b) - hi)
    return row[-1]


def test_edit_distance(spark):
    rng, rows = random.Random(1), []
    for _ in range(600):
        a = [rng.choice("abé😀") for _ in range(rng.randint(0, 9))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k, o = rng.randint(0, len(b)), rng.randint(0, 2)
            if o == 0:
                b.insert(k, rng.choice("abé"))
            elif k < len(b):
                b[k : k + 1] = [] if o == 1 else [rng.choice("abé")]
        rows.append(("".join(a), "".join(b)))
    got = {(r.line_a, r.line_b) for r in lines.verified(spark.createDataFrame(rows, "line_a string, line_b string")).collect()}
    assert got == {(a, b) for a, b in rows if _edits(a, b) <= 2}


# search


def test_topk(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), [float(x) for x in rng.normal(0, 0.3, 16)], "clash", 1) for k in range(400)]
    rows += [(50, rows[3][1], None, None), (401, None, "", 0), (402, [1.0, None] + [0.0] * 14, "", 0), (403, [float("nan")] * 16, "", 0), (404, [], "", 0)]
    rows += [(405, [float("inf")] * 16, "", 0), (406, [1e6] * 16, "", 0), (407, [0.5] * 3, "", 0), (450, [-1e6] * 16, "", 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, score int")
    ok = [(i, [int(np.floor(256 * x)) for x in e]) for i, e, *_ in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for q, e in ok:
        if q % 50 == 0:
            found = sorted(((-sum(a * b for a, b in zip(e, f, strict=False)), i) for i, f in ok if i != q))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    for chunk in (65_536, 4):
        got = topk.search(df, df.filter("vec_id % 50 = 0"), chunk=chunk)
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == sorted(want)
    none = df.limit(0)
    assert topk.search(none, none).count() == 0


# mixing


def test_mix(spark):
    rng = random.Random(6)
    rows = [(k, words(rng, rng.choice([0, 1, 3, 3, 40, 200])), ["a", "b", "b", "b", None, "cé"][k % 6], "clash", k) for k in range(400)]
    rows += [(1000, None, "a", "", 0), (1001, "x", "alone", "", 0), (5, rows[5][1], rows[5][2], "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string, copies int")
    got = mixing.mix(df).collect()
    size: dict = {}
    for _, t, s, *_ in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goal, free, left = {}, set(size), float(sum(size.values()))
    while True:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * size[s]]
        if not over:
            break
        for s in over:
            goal[s] = 3.0 * size[s]
            free.discard(s)
        left = sum(size.values()) - sum(goal.values())
    goal |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    assert len(got) == len(rows)
    taken: dict = {}
    for r in got:
        assert abs(r.target - goal[r.source]) < 1e-6 * (1 + goal[r.source]) and r.source_size == size[r.source] and 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for s in size:
        assert abs(taken[s] - goal[s]) <= max(3, 0.01 * goal[s])
    same = lambda rows: sorted(((r.doc_id, r.copies) for r in rows))
    assert same(got) == same(mixing.mix(df).collect())
    out = mixing.repeat_documents(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


# secrets


def test_trigram_queries():
    assert trigrams.query("abcd") == ("and", "abc", "bcd") and trigrams.query("[0-9]+") == () and trigrams.query("a?bc") == ()
    assert trigrams.query("(foo|bar)x") == ("or", ("and", "bar", "arx"), ("and", "foo", "oox"))
    assert trigrams.query("ab[cd]") == ("or", "abc", "abd") and trigrams.query("abc.*xyz") == ("and", "abc", "xyz")


def test_secrets(spark):
    hexes = "0123456789abcdef" * 2
    texts = [
        None, "", 'PassWord = "hunter22"', "secret: token: abcdefgh", "api_key='é12345678' apikey=AAAAAA", "é\U0001f600 token=abcdef, x " + hexes,
        "AKIA" + "A" * 16 + " AKIASHORT AKIAAKIA" + "B" * 20, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-123456789012", "http://me:pw@x",
        "eyJh.eyJi.sig", "AIza" + "x" * 35, "token" * 2000 + "=abcdefg " + hexes * 200, "paſſword=abcdefg toKen=abcdefg",
    ]
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, texts[5]), (None, texts[2])]
    want = []
    for d, t in rows:
        found = []
        for k, r in enumerate(secrets.RULES):
            pattern = r.pattern.replace("(?i:", "(?ai:")
            found += [(m.start(), k, m.end()) for m in re.finditer(pattern, t or "") if len(m.group(r.group)) >= r.least]
        found.sort()
        said = [f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in found]
        base = ",".join(s for s, (_, k, _) in zip(said, found, strict=True) if k < 3)
        n = Counter(k for _, k, _ in found)
        want.append((d, n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), ",".join(said)))
    got = [tuple(r) for r in secrets.report(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert secrets.report(docs(spark, [])).count() == 0


# toxicity


def test_toxicity(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(600):
        bad = k % 4 == 0
        w = words(rng, 60).split()
        for _ in range(4 if bad else 0):
            w[rng.randrange(60)] = rng.choice(["gruesomely", "horridness"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad), 1))
    rows += [(1000, None), (1001, ""), (1002, "##  !!"), (1003, words(rng, 70) + " gruesomly horidness horridnes gruesomelly"), (7, rows[7][1]), (1004, "a" * 300_000)]
    labels += [(9999, 1, 1), (3, None, 0)]
    known = spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    df = docs(spark, rows)
    got = {r.doc_id: r for r in toxicity.toxicity(df, known).collect()}
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for d, r in got.items() if d < 600 and r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert got[1003].predicted == 1 and got[1000].score == got[1001].score and got[1000].predicted == 0
    clean = toxicity.drop_toxic(df, known)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {d for d, r in got.items() if not r.predicted}
    assert {r.score for r in toxicity.toxicity(df, known.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(df.limit(0), known).count() == 0


def test_toxicity_learns_from_a_class_of_long_texts(spark, monkeypatch):
    rng = random.Random(10)
    monkeypatch.setattr(toxicity, "PER_CLASS", 40)
    rows, labels = [], []
    for k in range(200):
        bad = k % 4 == 0
        rows.append((k, words(rng, 30) + (" gruesomely horridness " + "gruesomely " * 2000 if bad else "")))
        labels.append((k, int(bad)))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs(spark, rows), known).collect()}
    assert sum(got[d] == (d % 4 == 0) for d in got) >= 195


def test_toxicity_sample_is_full_beside_long_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "PER_CLASS", 20)
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, share, seed: seen.append((texts, toxic)) or toxicity.Model(None))
    rows = [(k, f"w{k} " * (9000 if k % 4 < 2 else 3)) for k in range(200)]
    toxicity.fit(docs(spark, rows), spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int"))
    texts, toxic = seen[0]
    assert np.bincount(toxic).tolist() == [20, 20] and max(map(len, texts)) < 100


def test_training_gradients():
    """Against differences of the loss, in doubles."""
    rng = np.random.default_rng(2)
    count = np.array([3, 1, 5, 2])
    at = np.repeat(np.arange(4), count)
    vectors, soft, bias = rng.normal(size=(count.sum(), 6)), rng.normal(size=(6, 2)), rng.normal(size=2)
    label, tilt = np.array([0, 1, 1, 0]), np.array([0.5, 2.0, 1.0, 3.0])
    loss = lambda: toxicity.gradients(vectors, count, soft, bias, label, tilt)[0]
    mean = np.stack([vectors[at == k].mean(0) for k in range(4)]) @ soft + bias
    assert abs(loss() - np.mean([t * (np.log(np.exp(z).sum()) - z[y]) for z, y, t in zip(mean, label, tilt, strict=True)])) < 1e-9
    _, by_mean, by_soft, by_bias = toxicity.gradients(vectors, count, soft, bias, label, tilt)
    for values, told in ((vectors, by_mean[at]), (soft, by_soft), (bias, by_bias)):
        for k in np.ndindex(values.shape):
            held, step = values[k], 1e-6
            values[k] = held + step
            up = loss()
            values[k] = held - step
            assert abs((up - loss()) / (2 * step) - told[k]) < 1e-6
            values[k] = held
