"""Cases that the small tests of ``test_ops`` do not reach: large buckets, other numbers of partitions,
columns with the operators' own names, many spans in a text."""

import random
import time

import pytest

from symloom.llm import jaccard, lines, mixing, secrets
from symloom.llm.common import scratch_dir


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize(("small", "large"), [(2, (6, 20)), (2, (10_000, 20_000)), (8, (1_024, 65_536))])
def test_line_families(spark, monkeypatch, small, large):
    """Variants of one line, by letters and by words, in buckets of every kind."""
    monkeypatch.setattr(lines, "SMALL", small)
    monkeypatch.setattr(lines, "LARGE", large)
    rng = random.Random(small + large[0])
    base = [rng.choice(["anat", "the", "ontior", "blée", "re", "whinth"]) for _ in range(12)]
    found = []
    for k in range(70):
        some = list(base)
        for _ in range(rng.randint(0, 2)):
            some[rng.randrange(12)] = rng.choice(["quix", "jam", "vö", "zephyr"])
        line = list(" ".join(some))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(line))
            line[at : at + 1] = rng.choice([[], ["#"], [line[at], "+"]])
        found.append((k, "".join(line)))
    rows = [(d, t) for d, t in found] + [(d + 100, t) for d, t in found[:9]]
    first = {}
    for d, t in rows:
        first.setdefault(t, d)
    want = {d: "0" if first[t] != d or any(first[o] < d and _edits(o, t) <= 2 for o in first) else "" for d, t in rows}
    got = lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed for r in got} == want


def _edited(rng, line, edits):
    line = list(line)
    for _ in range(rng.randint(0, edits)):
        at = rng.randrange(len(line) + 1)
        line[at : at + rng.randint(0, 1)] = rng.choice([[], ["#"], ["ö"]])
    return "".join(line)


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_line_keys_are_few_and_lose_no_pair(spark, edits):
    """Lines of all lengths about the borders of a kind, each beside edited ones."""
    rng = random.Random(edits)
    pairs = []
    for size in range(24, 75):
        for letters in ("abcdefgh ", "aé😀b"):
            line = "".join(rng.choice(letters) for _ in range(size))
            pairs += [(line, _edited(rng, line, edits)) for _ in range(4)]
    texts = sorted({t for pair in pairs for t in pair})
    rows = spark.createDataFrame([(k, len(t), t) for k, t in enumerate(texts)], "h1 long, size int, line string")
    keys = {k: set() for k in range(len(texts))}
    found = lines.entries(rows, edits).select("h1", "key").collect()
    for k, key in found:
        keys[k].add(key)
    if edits == 2:
        assert len(found) <= 5.2 * len(texts)
    number = {t: k for k, t in enumerate(texts)}
    assert all(keys[number[a]] & keys[number[b]] for a, b in pairs if _edits(a, b) <= edits)


def test_edit_distance_without_equal_ends(spark):
    rng, rows = random.Random(8), []
    for k in range(240):
        a = "".join(rng.choice("ab" if k % 2 else "abcé😀 ") for _ in range(rng.choice([0, 1, 2, 5, 30, 64, 65, 140])))
        rows += [(a, _edited(rng, a, 4)), (a, a), (a, a[1:] + a[:1])]
    got = {(r.line_a, r.line_b) for r in lines.verified(spark.createDataFrame(rows, "line_a string, line_b string")).collect()}
    assert got == {(a, b) for a, b in rows if _edits(a, b) <= 2}


def test_line_columns_and_emptied(spark):
    line = "a line that is long enough to count"
    rows = [(1, line, "x", 1, 2, 3), (2, line, "y", 4, 5, 6), (3, line + "\nown words", "z", 7, 8, 9), (4, None, "n", 0, 0, 0), (5, " ", "b", 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string, doc int, row int, _doc int")
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    got = {tuple(r) for r in out.collect()}
    assert got == {rows[0], (2, "", *rows[1][2:]), (3, "own words", *rows[2][2:]), *rows[3:]}
    assert {r.doc_id for r in lines.dedup_lines(docs, emptied=False).collect()} == {1, 3, 4, 5}


def test_representatives_carry_columns(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text, "a", 1, "p", 2), (2, text + " more", "b", 3, "q", 4), (3, "other words here", "c", 5, "r", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, _n int, row string, copy int")
    out = jaccard.representatives(docs)
    assert out.columns == docs.columns and sorted(tuple(r) for r in out.collect()) == [rows[0], rows[2]]


def _copies(cells, goal, most=3):
    """{size: copies} of one source by bisection of the dual, rounding of running sums, and the walk."""
    import math

    scale = sum(n * s for s, n in cells) / sum(n for _, n in cells)
    rate = lambda x, s: min(float(most), math.exp(x * s / scale))
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        if sum(n * s * rate(mid, s) for s, n in cells) < goal:
            low = mid
        else:
            high = mid
    full = goal >= most * sum(n * s for s, n in cells)
    out, run, before = {}, 0.0, 0
    for s, n in sorted(cells, reverse=True):
        run += n * (float(most) if full else rate(low, s))
        upto = math.floor(run + 0.5)
        out[s], before = max(0, min(upto - before, most * n)), upto
    off = round(goal - sum(s * c for s, c in out.items()))
    for s, n in sorted(cells, reverse=True):
        d = (1 if off > 0 else -1) * min(abs(off) // s, most * n - out[s] if off > 0 else out[s]) if off else 0
        out[s] += d
        off -= d * s
    return out


def test_mix_is_the_same_on_any_cluster(spark):
    rng = random.Random(9)
    rows = [(k, " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([1, 2, 3, 7, 40, 90]))), rng.choice("abcd"), k) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, salt int")
    before, told = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (8, 5, 1):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            told.append(sorted((r.doc_id, r.copies) for r in mixing.mix(docs.repartition(n)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert told[0] == told[1] == told[2]
    got = mixing.mix(docs).collect()
    for s in "abcd":
        mine = [r for r in got if r.source == s]
        sizes = sorted({r.size for r in mine})
        want = _copies([(z, sum(r.size == z for r in mine)) for z in sizes], mine[0].target)
        assert {z: sum(r.copies for r in mine if r.size == z) for z in sizes} == want


def test_many_spans_take_linear_time(spark):
    took = []
    for n in (4_000, 32_000):
        text = " ".join(f"password: {'x' * (6 + k % 3)}" for k in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.time()
        got = secrets.report(docs).collect()[0]
        took.append(time.time() - start)
        assert got.n_assign == n
        assert got.spans.split(",")[:2] == ["assign:0:16", "assign:17:34"]
    assert took[1] < 8 * took[0] + 5


def test_scratch_needs_a_shared_folder_on_clusters():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    assert scratch_dir(Session(spark_master="local[8]")).startswith("file:///tmp")
    assert scratch_dir(Session(spark_master="yarn", spark_checkpoint_dir="s3://x/y/")) == "s3://x/y"
    with pytest.raises(ValueError, match="share"):
        scratch_dir(Session(spark_master="spark://host:7077"))
