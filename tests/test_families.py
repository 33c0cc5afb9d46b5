import numpy as np
import pytest
from pyspark.sql import functions as F

from symloom.functions import matrices
from symloom.functions.alphabets import AMINO, DNA, Alphabet, characters, decode, encode
from symloom.model import AlphabetError, DataError, OptionError, Options, resolve
from symloom.operators import families, pairwise, registry
from symloom.operators import progressive as pg

SCORES = matrices.blosum62()


def _members(texts):
    return [pg.member([np.array(AMINO.encode(t))], [AMINO.size]) for t in texts]


def _rows(spark, fams):
    rows = [(f, k, t) for f, texts in fams.items() for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "family_id long, ord int, text string")
    return df.withColumn("sets", F.array(encode(characters(F.col("text")), AMINO)))


FAMS = {1: ["HEAGAWGHEE", "PAWHEAE", "HEAGAWHEE"], 2: ["MKVLAA", "MKVLA", "MRVLAAG", "MKLAA"]}


def test_alphabets(spark):
    assert AMINO.size == 27 and AMINO.index("E") < AMINO.index("Q") + 2 and DNA.size == 15
    gap = Alphabet("gap", ("a", "b"), (0, 4))
    assert gap.size == 5 and gap.decode([4, 0]) == "ba"
    with pytest.raises(AlphabetError):
        AMINO.encode("a-")
    df = spark.createDataFrame([("ARN",), ("",)], "t string")
    out = df.select(encode(characters(F.col("t")), AMINO).alias("x")).select("x", F.array_join(decode(F.col("x"), AMINO), "").alias("t")).collect()
    assert [(r.x, r.t) for r in out] == [([0, 1, 2], "ARN"), ([], "")]
    with pytest.raises(Exception, match="symbol not in alphabet"):
        spark.createDataFrame([("A-",)], "t string").select(encode(characters(F.col("t")), AMINO)).collect()


def test_matrices():
    m = matrices.parse("# c\n  A B\nA 1 2 9\nB 3\n")
    assert (m.score("A", "B"), m.score("B", "A"), m.score("B", "B")) == (2, 3, 0)
    assert SCORES.score("W", "W") == 11 and SCORES.score("U", "A") == 0 and SCORES.score("B", "D") == 4 and SCORES.score("*", "A") == -4
    n = matrices.nucleotide()
    assert [n.score(*p) for p in ("AA", "AT", "AW", "AN", "WW", "NN", "BV")] == [5, -4, 1, -2, -1, -1, -2]
    assert (SCORES.dense == SCORES.dense.T).all()


def test_options():
    assert resolve({"linkage": "single"}, {"linkage": "complete"}).linkage == "complete"
    for bad in ({"gap_series": (-1.0, -1.0, -1.0)}, {"linkage": "x"}, {"preprofile_mode": "x"}):
        with pytest.raises(OptionError):
            Options(**bad)
    with pytest.raises(OptionError):
        Options().merge(nothing=1)


def test_stacks_and_distances_agree_with_the_family_kernel(spark):
    for mode in ("global", "local", "dummy"):
        opt = Options(preprofile_mode=mode, msa_mode="tree", merge_mode="global")
        got: dict = {}
        for r in families.preprofiles(_rows(spark, FAMS), [SCORES.dense], opt).collect():
            got.setdefault((r.family_id, r.ord), {})[(r.pos, r.sym)] = r.cnt
        for f, texts in FAMS.items():
            members = _members(texts)
            for k, m in enumerate(members):
                counts = pg.preprofile(m, members[:k] + members[k + 1 :], [SCORES.dense], opt).counts[0]
                assert got[(f, k)] == {(int(p), int(s)): int(counts[p, s]) for p, s in zip(*np.nonzero(counts), strict=True)}
    opt = Options()
    rows = families.distances(_rows(spark, FAMS), [SCORES.dense], opt)
    trees: dict = {}
    for r in families.guide_trees(rows, opt).orderBy("family_id", "step").collect():
        trees.setdefault(r.family_id, []).append((r.left, r.right))
    for f, texts in FAMS.items():
        assert trees[f] == pg.merge_order(pg.distances(_members(texts), [SCORES.dense], opt), "average")


@pytest.mark.parametrize("msa", ["tree", "adhoc"])
def test_families_align(spark, msa):
    opt = Options(msa_mode=msa, merge_mode="global")
    done = families.align_families(_rows(spark, FAMS), [SCORES.dense], opt)
    texts = _rows(spark, FAMS).select("family_id", "ord", "text")
    for r in families.gapped_rows(done, texts).collect():
        assert r.gapped.replace("-", "") == FAMS[r.family_id][r.ord]


@pytest.mark.parametrize("stack", ["global", "local", "dummy"])
@pytest.mark.parametrize("msa", ["tree", "adhoc"])
def test_families_align_as_the_family_kernel(spark, msa, stack):
    opt = Options(msa_mode=msa, preprofile_mode=stack, dist_mode="semiglobal_auto")
    fams = {**FAMS, 3: ["MKV"]}
    done = families.align_families(_rows(spark, fams), [SCORES.dense], opt).collect()
    assert {r.family_id for r in done} == set(fams)
    for r in done:
        path, items = pg.align_family(_members(fams[r.family_id]), [SCORES.dense], opt)
        assert (r.items, r.path) == (items, path.tolist())


def test_linkage_and_order():
    d = np.array([[0, 2, 9, 9], [2, 0, 8, 9], [9, 8, 0, 2], [9, 9, 2, 0]], dtype=float)
    assert pg.merge_order(d, "single") == [(0, 1), (2, 3), (0, 2)]
    assert pg.merge_order(d[:1, :1], "average") == []


def test_errors_and_registry(spark):
    with pytest.raises(DataError):
        pg.member([np.zeros(2, int), np.zeros(3, int)], [2, 2])
    with pytest.raises(DataError):
        pg.gapped(np.array([[-1], [0]]), 0, "A")
    registry.register_aligner("none", lambda g, *_: (0.0, np.zeros((1, 2), int)))
    try:
        with pytest.raises(OptionError):
            registry.register_aligner("none", None)
        pairs = pairwise.unordered_pairs(_rows(spark, FAMS))
        assert {r.score for r in pairwise.align_pairs(pairs, [SCORES.dense], Options(aligner="none")).collect()} == {0.0}
    finally:
        registry.unregister_aligner("none")
    registry.register_sql(spark)
    assert spark.sql("SELECT align_score('HEAE', 'HEAE', 'global') s").first().s == 22.0
