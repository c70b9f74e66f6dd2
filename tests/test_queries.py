"""Every query that has an oracle gives DuckDB's rows at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from trellis import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, str):
        return x
    if hasattr(x, "__len__"):
        return tuple(map(plain, x))
    if pd.isna(x):
        return None
    return round(float(x), 6) + 0.0 if isinstance(x, float) else x


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_duckdb(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b) and [tuple(map(float_, r)) for r in a] == [tuple(map(float_, r)) for r in b]


def float_(x):
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).collect() is not None


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["e1", "e2", "shared"]
