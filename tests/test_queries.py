"""Each query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from cladeframe import queries as core

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{TABLES}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, db, name):
    got = core.queries()[name](spark, TABLES)
    sql = db.execute(core.oracle_sql()[name])
    columns = [c[0] for c in sql.description]
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(r[c] for c in sorted(columns)) for r in got.collect()]
    expected = [tuple(r[columns.index(c)] for c in sorted(columns)) for r in sql.fetchall()]
    assert sorted(rows, key=str) == sorted(expected, key=str)
