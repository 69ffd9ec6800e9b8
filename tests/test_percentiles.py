"""Exact percentiles by narrowing against sorted lists."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import metrics


def at(values, share):
    values = sorted(values, key=lambda v: (math.isnan(v), v))
    return values[min(math.floor(len(values) * share), len(values) - 1)]


@pytest.mark.parametrize("rounds", [None, 0, 1, 2, 3])
def test_percentiles(spark, monkeypatch, rounds):
    """Outliers, ties, infinities, NaN, single rows, null keys, and columns of our own names."""
    monkeypatch.setattr(metrics, "PARTS", 8)
    monkeypatch.setattr(metrics, "SORTED_ROWS", 300)
    rng = np.random.default_rng(1)
    groups = {"hot": rng.lognormal(0, 3, 3000), "ties": np.repeat([1.0, 2.0, 2.5], 100), "one": [7.0], None: rng.normal(0, 1, 50), "wide": [-1e308, 1e308, 0.0, 1.0, -math.inf, math.inf], "nan": [math.nan, 1.0, 2.0, math.nan, math.inf], "near": 1 + rng.integers(0, 9, 200) * 1e-15}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("nulls", None), ("hot", None)]
    df = spark.createDataFrame(rows, "kind string, v double").withColumns({c: F.lit("own") for c in ("share", "lo", "index", "n", "part", "c")}).repartition(6)
    shares = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {r["kind"]: r for r in metrics.indexed_percentiles(df, ["kind"], "v", shares, rounds=rounds).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        for p in shares:
            found, want = got[k][f"p{round(p * 100)}"], at([float(v) for v in vs], p)
            assert found == want or (math.isnan(found) and math.isnan(want)), (k, p)


def test_whole_numbers_and_no_rows(spark):
    df = spark.range(1001).select((F.col("id") % 3).alias("k"), F.col("id"))
    got = metrics.indexed_percentiles(df, ["k"], "id", [0.5], rounds=2).orderBy("k").collect()
    assert [r["p50"] for r in got] == [sorted(range(k, 1001, 3))[len(range(k, 1001, 3)) // 2] for k in range(3)]
    assert metrics.indexed_percentiles(df.limit(0), ["k"], "id", [0.5]).count() == 0


def test_one_hot_key_is_counted_by_many_tasks(spark, capsys):
    """No exchange carries rows: what is dealt by key has been counted in each task."""
    df = spark.range(5000).select(F.lit(1).alias("k"), F.rand(1).alias("v")).repartition(8)
    metrics.indexed_percentiles(df, ["k"], "v", [0.5], rounds=2).explain("formatted")
    plan = capsys.readouterr().out
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
