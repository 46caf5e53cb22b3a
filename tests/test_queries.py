"""Every query with an SQL twin against DuckDB on the smallest tables; the others return rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lumenframe import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "NULL"
    return f"{x + 0.0:.5f}" if isinstance(x, float) else str(x)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    out = catalogue.QUERIES[name](spark, SF)
    got = rows(out.columns, out.collect())
    if name in catalogue.ORACLE_SQL:
        want = duck.sql(catalogue.ORACLE_SQL[name])
        assert sorted(out.columns) == sorted(want.columns)
        assert got == rows(want.columns, want.fetchall())
    assert len(set(out.columns)) == len(out.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
