"""Linear heads: fitting with MLlib, prediction with broadcast weights."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.profile import class_weights


def dot(vector: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(vector, F.array(*(F.lit(float(w)) for w in weights)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def fit_classifier(df: DataFrame, vector: str, label: str, c: float = 10.0) -> dict:
    """A balanced multinomial logistic head with inverse regularisation c."""
    classes = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    code = F.array_position(F.array(*(F.lit(x) for x in classes)), F.col(label)).cast("double") - 1
    rows = df.join(F.broadcast(class_weights(df, label).withColumnRenamed("label", label)), label)
    rows = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), code.alias("label"), "weight")
    penalty = 1 / (c * max(1, df.count()))
    fit = LogisticRegression(weightCol="weight", regParam=penalty, standardization=False, maxIter=2000, family="multinomial").fit(rows)
    return {"classes": classes, "coef": fit.coefficientMatrix.toArray().tolist(), "intercept": fit.interceptVector.toArray().tolist()}


def predict_class(df: DataFrame, head: dict, vector: str) -> DataFrame:
    """df with predicted and probability, the first class on ties.

    A head with one row of weights has two classes, and the row scores the second by a sigmoid; else it is a softmax with
    a shifted maximum.
    """
    scores = [dot(F.col(vector), w) + F.lit(float(b)) for w, b in zip(head["coef"], head["intercept"], strict=True)]
    scores = [F.lit(0.0), *scores] if len(scores) == 1 else scores  # sigmoid(z) is the softmax of (0, z)
    found = F.transform(F.array(F.array(*scores)), lambda z: F.struct(z.alias("z"), F.array_max(z).alias("top")))[0]
    out = df.withColumn("scored", found)
    best = F.array_position("scored.z", F.col("scored.top")).cast("int")
    total = F.aggregate("scored.z", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("scored.top")))
    classes = F.array(*map(F.lit, head["classes"]))
    return out.withColumn("predicted", F.element_at(classes, best)).withColumn("probability", 1 / total).drop("scored")


def fit_regressor(df: DataFrame, vector: str, target: str, alpha: float = 1.0) -> dict:
    """Ridge; MLlib scales its penalty by the target's deviation."""
    s = df.agg(F.count("*").alias("n"), F.stddev_pop(target).alias("sd"), F.min(target).alias("lo"), F.max(target).alias("hi")).first()
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(target).cast("double").alias("label"))
    fit = LinearRegression(solver="normal", standardization=False, regParam=alpha * (s["sd"] or 0.0) / max(1, s["n"])).fit(rows)
    return {"coef": fit.coefficients.toArray().tolist(), "intercept": float(fit.intercept), "score_min": s["lo"], "score_max": s["hi"]}


def predict_score(df: DataFrame, head: dict, vector: str) -> DataFrame:
    raw = dot(F.col(vector), head["coef"]) + F.lit(float(head["intercept"]))
    return df.withColumn("predicted", F.least(F.lit(float(head["score_max"])), F.greatest(F.lit(float(head["score_min"])), raw)))
