"""Every query over the smallest test data; those with SQL against it."""

import glob
import os

import pytest

from plumbline.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
COLUMNS = {"p1_found": ["file_id"], "p2_found": ["file_id", "symbol_id"], "p3_found": ["file_id"], "p4_found": ["symbol_id"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "span_start", "span_end"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = [repr(r) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name in ORACLES:
        duckdb = pytest.importorskip("duckdb")
        c = duckdb.connect()
        for p in glob.glob(f"{DATA}/*.parquet"):
            c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        assert sorted(c.execute(ORACLES[name]).fetchall()) == sorted(tuple(r) for r in df.collect())
