import numpy as np
import pytest

from symloom.__main__ import main
from symloom.functions import matrices
from symloom.model import DataError
from symloom.sources import text


def test_fasta_reader_drops_what_it_should(spark, tmp_path):
    (tmp_path / "a.fa").write_text("lost\n>\nAAA\n>one two  \nAR \n N\n>none\n\n>last\r\nQQ\r\n")
    rows = text.read_fasta(spark, str(tmp_path)).collect()
    assert [(r.ord, r.name, r.residues) for r in rows] == [(0, "one two", "ARN"), (1, "last", "QQ")]
    spark.dataSource.register(text.FastaSource)
    rows = spark.read.format("fasta").option("path", str(tmp_path)).load().collect()
    assert [(r.ord, r.name, r.residues) for r in rows] == [(0, "one two", "ARN"), (1, "last", "QQ")]


def test_alignment_round_trip():
    rows = ["A-RN" * 30, "AAR-" * 30]
    names, residues, path = text.read_alignment([("x", rows[0]), ("y", rows[1])])
    assert residues == [r.replace("-", "") for r in rows] and path[-1].tolist() == [90, 90]
    lines = text.aligned_fasta(names, rows).splitlines()
    assert lines[0] == ">x" and max(map(len, lines)) == 72 and text.aligned_fasta(names, rows).endswith("\n")
    for bad in ([], [("x", "A"), ("y", "AA")]):
        with pytest.raises(DataError):
            text.read_alignment(bad)


def test_clustal_and_conservation():
    m = matrices.identity()
    assert text.conservation(["AAA-", "AAR-", "ARN-"], m) == "*: ".ljust(4)
    assert text.conservation(["A"], None) == " "
    out = text.clustal(["a long name indeed", "b"], ["A" * 70, "A" * 70], m).split("\n")
    assert out[3].startswith("a long name i     A") and out[5].strip() == "*" * 60 and out[-1] == ""


def test_pssm_and_features():
    m = matrices.identity(match=2.0)
    shares = np.zeros((1, 27))
    shares[0, 0] = 1
    lines = text.pssm(["A"], "R", shares, m).split("\n")
    assert lines[0].split("\t")[:4] == ["P", "C", "Master", "A"] and lines[1].split("\t")[:5] == ["1", "A", "1-R", "2.0", "0.0"]
    out = text.features(["s one"], [("t", "site", {"M": "red"}, ["*M*M"])]).splitlines()
    assert out == ["t_M\tred", "site\ts\t-1\t2\t2\tt_M", "site\ts\t-1\t4\t4\tt_M"]


def test_search_hits(spark):
    hit = "<Hit><Hit_id>{}</Hit_id><Hsp><Hsp_evalue>{}</Hsp_evalue></Hsp><Hsp><Hsp_evalue>9</Hsp_evalue></Hsp></Hit>"
    it = "<Iteration><Iteration_iter-num>{}</Iteration_iter-num>{}</Iteration>"
    xml = "<?xml version='1.0'?>\n<B>" + it.format(1, hit.format("old", 0)) + it.format(2, hit.format("a", "1e-5") + hit.format("b", 3) + hit.format("c", 0.5)) + "</B>"
    files = spark.createDataFrame([("f", xml)], "path string, value string")
    hits = text.blast_hits(files)
    assert [(r.rank, r.hit_id, r.evalue) for r in hits.orderBy("rank").collect()] == [(1, "a", 1e-5), (2, "b", 3.0), (3, "c", 0.5)]
    assert [r.hit_id for r in text.best_hits(hits, 2, 1.0).collect()] == ["a"]


def test_command_line(tmp_path):
    (tmp_path / "in.fa").write_text(">a\nHEAGAWGHEE\n>b\nPAWHEAE\n>c\nHEAGAWHEE\n")
    for extra in (["--msa", "tree", "--preprofile", "global"], ["-f", "clustal", "--merge", "semiglobal_auto"]):
        main([str(tmp_path / "in.fa"), str(tmp_path / "out"), *extra])
        assert "HEA" in (tmp_path / "out").read_text()


def test_aligned_fasta_and_features_as_rows(spark):
    rows = [(1, 1, "b" * 80, "-" * 73), (1, 0, "a", "AC-" * 24), (2, 0, "c", "")]
    out = text.aligned_fasta_text(spark.createDataFrame(rows, "k int, ord int, name string, gapped string"), ["k"])
    want = {1: text.aligned_fasta(["a", "b" * 80], ["AC-" * 24, "-" * 73]), 2: text.aligned_fasta(["c"], [""])}
    assert {r.k: r.value for r in out.collect()} == want
    symbols = spark.createDataFrame([(7, "t", k, c) for k, c in enumerate("HCH")], "id int, track string, pos int, symbol string")
    found = text.feature_rows(symbols, {"t_H": "red"}, ["id"]).collect()
    assert sorted(tuple(r) for r in found) == [(7, 1, 1, "t_H"), (7, 3, 3, "t_H")]
