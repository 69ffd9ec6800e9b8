"""Sparse logistic regression against the slope of its loss and Spark's own fit."""

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tesserae.operators import extract, logistic
from tesserae.operators.logistic import lbfgs, loss_and_gradient, mean_loss


def sparse_rows(n=300, features=12, classes=3, seed=0):
    rng = np.random.default_rng(seed)
    truth, rows = rng.normal(size=(features, classes)), []
    for _ in range(n):
        at = np.sort(rng.choice(features, int(rng.integers(0, 5)), replace=False))
        value = rng.normal(size=len(at))
        z = value @ truth[at] + rng.gumbel(size=classes)
        rows.append((at.tolist(), value.tolist(), int(z.argmax()), float(rng.uniform(0.5, 2))))
    return rows


def test_gradient_is_the_slope_and_sums_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(logistic, "FAN_IN", 2)
    rows = sparse_rows()
    df = spark.createDataFrame(rows, "at array<int>, value array<double>, label int, weight double").repartition(7)
    w = np.random.default_rng(1).normal(size=(13, 3))
    first = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])])
    flat = [np.array([x for r in rows for x in r[k]], t) for k, t in ((0, int), (1, float))]
    label, weight = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    loss, g = loss_and_gradient(w, *flat, first, label, weight)
    mean, mean_g = mean_loss(df, w, 0.3)
    held = np.vstack([w[:-1], np.zeros((1, 3))])
    assert np.isclose(mean, loss / weight.sum() + 0.15 * (held**2).sum()) and np.allclose(mean_g, g / weight.sum() + 0.3 * held)
    for i, j in ((0, 0), (12, 1), (5, 2)):
        d = np.zeros_like(w)
        d[i, j] = 1e-6
        slope = (loss_and_gradient(w + d, *flat, first, label, weight)[0] - loss_and_gradient(w - d, *flat, first, label, weight)[0]) / 2e-6
        assert np.isclose(g[i, j], slope, rtol=1e-4, atol=1e-4)


def test_weights_are_those_of_sparks_own_fit(spark):
    rows = sparse_rows()
    df = spark.createDataFrame(rows, "at array<int>, value array<double>, label int, weight double").cache()
    w = lbfgs(lambda w: mean_loss(df, w, 0.01), np.zeros((13, 3)), tolerance=1e-10)
    dense = spark.createDataFrame([(Vectors.sparse(12, dict(zip(a, v, strict=True))), float(k), x) for a, v, k, x in rows], ["features", "label", "weight"])
    fit = LogisticRegression(weightCol="weight", regParam=0.01, standardization=False, maxIter=500, tol=1e-10, family="multinomial").fit(dense)
    assert np.allclose(w[:-1], fit.coefficientMatrix.toArray().T, atol=2e-3)
    assert np.allclose(w[-1] - w[-1].mean(), fit.interceptVector.toArray(), atol=2e-3)


def test_hashed_features(spark):
    """Fewer weights than features: the tagger still learns what tells the tags apart."""
    texts = [(i, f"the {w} ran to {p} fast", [("A", p)]) for i, (w, p) in enumerate((w, p) for w in ("cat", "dog", "fox") for p in ("Paris", "Rome", "Oslo", "Bonn"))]
    df = spark.createDataFrame(texts, "id long, text string, entities array<struct<type:string,text:string>>")
    for most in (500_000, 64):
        weights, intercepts = extract.fit_tagger(df, "id", most=most)
        found = extract.extract(df, weights, intercepts, "id").select("id", "type", "surface").collect()
        assert sorted(map(tuple, found)) == [(i, "A", e[0][1]) for i, _, e in texts]
    assert weights.select(F.count_distinct("weight")).first()[0] <= 64 * 2
