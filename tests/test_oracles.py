"""Every query of the core against its SQL on the smallest test data."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

from plumbline.queries import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x
    return sorted(repr([cell(v[i]) for i in order]) for v in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, db, name):
    got = QUERIES[name](spark, DATA)
    want = db.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(got.columns, [tuple(r) for r in got.collect()]) == plain(names, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
