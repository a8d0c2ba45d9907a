"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from replicalog import queries

DATA = entry.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    d = queries.QUERIES[name](spark, DATA)
    columns = sorted(d.columns)
    want = duck.sql(queries.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    said = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert said(d.select(columns).collect()) == said(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["folder", "name", "reason", "winner_replica", "size"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
