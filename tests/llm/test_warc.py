import zlib

import pytest
from pyspark.sql import functions as F

from symloom.llm import warc

SCHEMA = "page_id long, url string, html string, file string, replica int"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"http://x/{k}", "<p>" + "é" * (k % 37) + "</p>", "clash", 1) for k in range(700)]
    rows += [(7, "http://x/7", "<p>" + "é" * 7 + "</p>", None, None), (800, None, None, None, 0), (None, "u", "", None, None), (801, "long", "y" * 200_000, "", 2)]
    return spark.createDataFrame(rows, SCHEMA)


def test_records_parse_back(spark, pages, tmp_path):
    rows = warc.archive(pages, 100).orderBy("file", "ordinal").collect()
    files: dict[int, bytes] = {}
    for r in rows:
        assert len(files.get(r.file, b"")) == r.offset
        files[r.file] = files.get(r.file, b"") + bytes(r.record)
    for k, data in files.items():
        (tmp_path / f"{k}.warc").write_bytes(data)
    back = warc.read_archive(spark, str(tmp_path)).collect()
    assert len(back) == len(rows) == pages.count()
    assert sorted((r.offset, r.length) for r in back) == sorted((r.offset, r.length) for r in rows)
    blocks = sorted(bytes(r.block) for r in back)
    assert blocks == sorted((p.html or "").encode() for p in pages.collect())


def test_record_bytes_agree(pages):
    rows = {(r.page_id, r.url): bytes(r.record) for r in pages.select("page_id", "url", warc.record().alias("record")).collect()}
    assert rows[(5, "http://x/5")] == warc.record_bytes(5, "http://x/5", "<p>" + "é" * 5 + "</p>")


def test_audit_finds_exactly_the_damage(pages):
    good = warc.archive(pages, 50)
    found = {(r.page_id, r.status) for r in warc.audit(good, warc.damaged(good)).collect()}
    want = set()
    for p in pages.collect():
        if p.page_id is None:
            continue
        c = zlib.crc32(str(p.page_id).encode())
        if c % 83 == 2:
            want.add((p.page_id, "missing"))
        elif c % 97 == 0 or c % 89 == 1:
            want.add((p.page_id, "changed"))
    assert found == want and want


def test_equal_and_empty_replicas(pages):
    good = warc.archive(pages, 50)
    assert warc.audit(good, good).count() == 0
    none = good.limit(0)
    assert warc.audit(none, none).count() == 0
    assert {r.status for r in warc.audit(good, none).collect()} == {"missing"}
    extra = warc.audit(good.filter(F.col("ordinal") > 0), good).collect()
    assert {r.status for r in extra} == {"extra"} and all(r.ordinal == 0 for r in extra)


def test_files_larger_than_their_tree(spark):
    rows = [(1, f"{f}-{k}", f, k, 10 * k, 10, f"{f}-{k}") for f in range(2) for k in range(40)]
    a = spark.createDataFrame(rows, "page_id long, id string, file long, ordinal long, offset long, length long, sha string")
    b = a.filter("NOT (file = 0 AND ordinal = 20)").withColumn("sha", F.when(F.expr("file = 1 AND ordinal = 4"), F.lit("x")).otherwise(F.col("sha")))
    found = {(r.file, r.ordinal, r.status) for r in warc.audit(a, b, depth=1).collect()}
    assert found == {(0, 20, "missing"), (1, 4, "changed")}


@pytest.mark.parametrize("same", [True, False])
def test_rows_of_one_key_are_dealt_over_files(spark, same):
    html = F.lit("x") if same else F.col("id").cast("string")
    pages = spark.range(6000).select(F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), html.alias("html"))
    got = warc.archive(pages, 500)
    size = [r["count"] for r in got.groupBy("file").count().collect()]
    assert sum(size) == 6000 and max(size) < 3000 and got.select("file", "ordinal").distinct().count() == 6000
    assert got.select("record").distinct().count() == (1 if same else 6000)


def test_shifted_records_are_no_damage(spark, pages):
    good = warc.archive(pages, 200)
    rest = warc._laid_out(good.filter("page_id IS NULL OR page_id <> 9"), "ordinal")
    found = warc.audit(good, rest).collect()
    assert [(r.page_id, r.status) for r in found] == [(9, "missing")]
    assert [(r.page_id, r.status) for r in warc.audit(rest, good).collect()] == [(9, "extra")]
    there = good.filter("page_id = 9").select("file", "ordinal", "offset", F.expr("offset + length")).first()
    assert (found[0].file, found[0].ordinal, found[0].first_byte, found[0].stop_byte) == tuple(there)


def test_one_of_equal_records_is_missing(pages):
    good = warc.archive(pages, 10_000)
    first = good.filter("page_id = 7").agg(F.min("ordinal")).first()[0]
    rest = warc._laid_out(good.filter(F.col("ordinal") != first), "ordinal")
    assert [(r.page_id, r.status) for r in warc.audit(good, rest).collect()] == [(7, "missing")]


def test_damaged_replica_has_its_own_offsets(pages):
    rows = warc.damaged(warc.archive(pages, 200)).orderBy("file", "ordinal").collect()
    end: dict[int, int] = {}
    for r in rows:
        assert r.offset == end.get(r.file, 0) and r.length == len(r.record)
        end[r.file] = r.offset + r.length
