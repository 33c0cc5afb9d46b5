import glob
import os

import duckdb
import pytest

from symloom.plans import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    out = catalog.QUERIES[name](spark, DIR).toPandas()
    assert len(out)
    if name in catalog.ORACLES:
        want = con.execute(catalog.ORACLES[name]).df()
        columns = sorted(out.columns)
        assert columns == sorted(want.columns)
        tidy = lambda d: d[columns].astype(str).sort_values(columns).reset_index(drop=True)
        assert tidy(out).equals(tidy(want))


def test_alignments_give_back_their_texts(spark):
    texts = {(r.family_id, r.ord): r.name for r in catalog._name_families(spark, DIR).collect()}
    for name in ("msa_tree", "msa_adhoc", "msa_multitrack"):
        rows = catalog.QUERIES[name](spark, DIR).collect()
        assert {(r.family_id, r.ord): r.gapped.replace("-", "") for r in rows} == texts
        width: dict[int, set] = {}
        for r in rows:
            width.setdefault(r.family_id, set()).add(len(r.gapped))
        assert all(len(w) == 1 for w in width.values())
