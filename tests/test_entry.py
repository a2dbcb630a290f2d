"""Every query with SQL equals DuckDB's result on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quern import queries as engine

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(rows):
    return sorted(map(repr, (tuple(None if v != v else v for v in row) for row in rows)))


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = engine.queries()[name](spark, DATA)
    want = duck.sql(engine.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert plain(map(tuple, got.select(*(f"`{c}`" for c in columns)).collect())) == plain(tuple(r[k] for k in order) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
