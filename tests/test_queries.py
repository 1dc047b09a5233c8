"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def tidy(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple("" if pd.isna(v) else round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, sf_dir, name):
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = tidy(got), tidy(want)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and abs(x - float(y)) <= 2e-6) or float(x) == float(y) for x, y in zip(a, b))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
