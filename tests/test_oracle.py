"""Every query with an SQL twin gives the rows that DuckDB gives."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(columns, data):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted((tuple(plain(r[i]) for i in at) for r in data), key=lambda t: tuple((x is None, x or "") for x in t))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    r = duck.execute(SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in r.description], r.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)
