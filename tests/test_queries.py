"""Every registered query against its oracle at the smallest scale, and the driver contract."""

import os

import pytest

import __spark_entry__ as entry
from fieldmill.checks.base import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, oracle, name):
    from compare import rows_of
    df = entry.queries()[name](spark, FOLDER)
    got = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = oracle.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows_of(names, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
