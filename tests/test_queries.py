"""Every query with SQL against DuckDB, and every other one for its rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sparrowlens import queries as core


def plain(x):
    if hasattr(x, "tolist") and not isinstance(x, str | bytes):
        x = x.tolist()
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 6)
    return [plain(y) for y in x] if isinstance(x, list | tuple) else x


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((repr([plain(v) for v in r]) for r in frame[columns].itertuples(index=False, name=None)))


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_same_as_sql(spark, duck, sf_dir, name):
    assert rows(core.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(core.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL)))
def test_without_sql(spark, sf_dir, name):
    assert core.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())
