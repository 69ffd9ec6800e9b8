"""Contrastive tuning and global numbering against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from tesserae.operators import contrastive, records
from tesserae.operators.contrastive import Tuning, batched, gradient_over, loss_and_gradient, tune
from tesserae.plans import models


def random_pairs(spark, n, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(n, dim))
    noise = rng.normal(size=(n, dim)) * np.array([0.1, 0.1, 0.1, 4, 4, 4])  # half of the dimensions mislead
    rows = [(i, a.tolist(), (a * np.array([1, 1, 1, 0, 0, 0]) + b).tolist()) for i, (a, b) in enumerate(zip(q, noise, strict=True))]
    return spark.createDataFrame(rows, "pair_id long, query_vector array<double>, passage_vector array<double>")


def test_gradient_is_the_slope():
    rng = np.random.default_rng(1)
    w, q, p = rng.normal(size=(4, 4)), rng.normal(size=(3, 5, 4)), rng.normal(size=(3, 5, 4))
    loss, g = loss_and_gradient(w, q, p, 20.0)
    by_hand = 0.0
    for a, b in zip(q, p, strict=True):
        x, y = (v @ w.T / np.linalg.norm(v @ w.T, axis=1, keepdims=True) for v in (a, b))
        s = np.exp(20 * x @ y.T)
        by_hand += -np.log(np.diag(s) / s.sum(axis=1)).mean()
    assert np.isclose(loss, by_hand)
    for i, j in ((0, 0), (1, 3), (3, 2)):
        d = np.zeros_like(w)
        d[i, j] = 1e-6
        slope = (loss_and_gradient(w + d, q, p, 20.0)[0] - loss_and_gradient(w - d, q, p, 20.0)[0]) / 2e-6
        assert np.isclose(g[i, j], slope, rtol=1e-4, atol=1e-6)


def test_sums_over_partitions_are_one_matrix(spark, monkeypatch):
    monkeypatch.setattr(contrastive, "FAN_IN", 2)
    pairs = random_pairs(spark, 75)
    bad = [(900, None, [1.0] * 6), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], [1.0] * 6)]
    pairs = pairs.union(spark.createDataFrame(bad, pairs.schema))
    rows = batched(pairs, 8, 1, 3).repartition(7).cache()
    held = rows.collect()
    assert len(held) == 9  # 75 pairs: the last three wait for the next epoch
    q, p = (np.array([r[c] for r in held]).reshape(9, 8, 6) for c in ("q", "p"))
    known = {tuple(r["query_vector"]): tuple(r["passage_vector"]) for r in pairs.where("pair_id < 900").collect()}
    assert all(known[tuple(a)] == tuple(b) for x, y in zip(q, p, strict=True) for a, b in zip(x, y, strict=True))
    assert len({tuple(a) for x in q for a in x}) == 72
    w = np.eye(6) + 0.1
    loss, gradient, n = gradient_over(rows, w, 8, 20.0)
    want_loss, want = loss_and_gradient(w, q, p, 20.0)
    assert n == 9 and np.isclose(loss, want_loss / 9) and np.allclose(gradient, want / 9)


def test_tuning_finds_what_helps(spark):
    pairs = random_pairs(spark, 400)
    w, losses = tune(pairs, 6, Tuning(epochs=2, steps_an_epoch=5, rate=0.1))
    assert len(losses) == 10 and np.mean(losses[-3:]) < 0.8 * losses[0]
    kept = np.abs(w[:3, :3]).sum() / np.abs(w[3:, 3:]).sum()
    assert kept > 1.2
    same, none = tune(pairs.limit(5), 6, Tuning(epochs=1))
    assert not none and (same == np.eye(6)).all()


def test_held_out_retrieval_rises(spark, sf_dir):
    found = {r["phase"]: r for r in models.m06(spark, sf_dir).collect()}
    assert found["tuned"]["mrr"] > found["plain"]["mrr"] and found["tuned"]["recall_1"] > found["plain"]["recall_1"]
    assert found["plain"]["queries"] == found["tuned"]["queries"] > 20


def test_numbering_splits_equal_values(spark):
    """A constant leading column over several ranges, nulls, repeated rows and columns of our own names."""
    rows = [(1, i % 50 if i % 7 else None, f"t{i}") for i in range(1000)] + [(1, 3, "same")] * 300
    df = spark.createDataFrame(rows, "a int, b int, place string").withColumns({c: F.lit("own") for c in ("own", "part", "size", "before")}).repartition(5)
    found = records.numbered(df, ["a", "b"], "n", parts=6)
    got = found.collect()
    assert found.columns == [*df.columns, "n"] and sorted(r["n"] for r in got) == list(range(1, 1301))
    assert [(r["b"] is not None, r["b"] or 0) for r in sorted(got, key=lambda r: r["n"])] == sorted((b is not None, b or 0) for _, b, _ in rows)
    assert {r["own"] for r in got} == {"own"} and sorted(r["place"] for r in got) == sorted(r[2] for r in rows)
    constant = records.numbered(df, ["a"], "n", parts=6).select("n", F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert max(r["count"] for r in constant) < 600
    assert records.numbered(df.limit(0), ["a"]).count() == 0
    split = records.split_positional(df.withColumn("rn", F.lit(0)), ["a", "b"], 0.9)
    assert split.where("split = 'train'").count() == 1170 and split.columns[-2:] == ["rn", "split"]
