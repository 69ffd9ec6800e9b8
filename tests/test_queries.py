"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tesserae.plans.base import ORACLES, QUERIES

assert __spark_entry__.REGISTERING  # they register on import


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None:
        return ("",)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, bool):
        return (str(v),)
    try:
        x = float(v)
    except (TypeError, ValueError):
        return (str(v),)
    return ("",) if math.isnan(x) else ("n", round(x, 6))


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0
