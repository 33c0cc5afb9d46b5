import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from symloom.model import DataError
from symloom.operators import profiles, tracks


def rows(spark):
    return spark.createDataFrame([(1, {"input": [0, 1, 2], "b": [1, 1, 1]}), (2, {"input": [], "b": []})], "id int, t map<string, array<int>>")


def column(spark, edit):
    return [r.x for r in rows(spark).orderBy("id").select(edit(F.col("t")).alias("x")).collect()]


def test_edits(spark):
    same = F.col("t")["input"]
    assert column(spark, lambda t: tracks.names(tracks.add(t, "c", same))) == [["b", "c", "input"]] * 2
    assert column(spark, lambda t: tracks.get(tracks.add(t, "c", same), "c")) == [[0, 1, 2], []]
    assert column(spark, lambda t: tracks.delete(t, "b")) == [{"input": [0, 1, 2]}, {"input": []}]
    assert column(spark, lambda t: tracks.get(tracks.replace(t, "b", F.reverse(same)), "b")) == [[2, 1, 0], []]
    alone = column(spark, lambda t: tracks.add(tracks.delete(tracks.delete(t, "b"), "input"), "c", F.array(F.lit(7))))
    assert alone == [{"c": [7]}] * 2  # without tracks any length will do


@pytest.mark.parametrize(
    "edit",
    [
        lambda t: tracks.add(t, "b", F.col("t")["b"]),
        lambda t: tracks.add(t, "c", F.array(F.lit(1))),
        lambda t: tracks.replace(t, "b", F.array(F.lit(1))),
        lambda t: tracks.delete(t, "c"),
        lambda t: tracks.replace(t, "c", F.col("t")["b"]),
        lambda t: tracks.get(t, "c"),
    ],
)
def test_edits_that_raise(spark, edit):
    with pytest.raises(PySparkException):
        column(spark, edit)


def test_renaming(spark):
    sets = F.array(F.array(F.lit("input"), F.lit("m")), F.array(F.lit("m")))
    got = rows(spark).limit(1).select(tracks.rename_in_sets(sets, "input", "preprofile").alias("x")).first().x
    assert got == [["preprofile", "m"], ["m"]]
    with pytest.raises(DataError):
        tracks.rename_in_sets(sets, "", "x")


def test_lookup_of_absent_pairs(spark):
    matrix = spark.createDataFrame([(0, 1, 2.5)], "sym_a int, sym_b int, score double")
    pairs = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, None, 1)], "id int, sym_a int, sym_b int")
    assert {r.id: r.score for r in profiles.lookup(pairs, matrix).collect()} == {1: 2.5, 2: 0.0, 3: 0.0}
