"""Every table query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from ledgerloom.plans.archive_queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    mine = QUERIES[name](spark, DATA)
    theirs = con.sql(ORACLE_SQL[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    order = [mine.columns.index(c) for c in columns]
    got = sorted(repr(tuple(r[i] for i in order)) for r in mine.collect())
    order = [theirs.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in theirs.fetchall())
