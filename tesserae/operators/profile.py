"""Profiles of datasets: label histograms, score buckets, coverage, set differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import text as T


def label_profile(df: DataFrame, label: str = "label", low: int = 50) -> DataFrame:
    """(label, n, pct, low) of every label; the share is over the few labels' counts, not over rows."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("total")).alias("pct"), (F.col("n") < low).alias("low"))


def label_gaps(df: DataFrame, taxonomy: list[str], label: str = "label") -> DataFrame:
    """(label, side): configured labels (lower-cased) that no row has, and observed ones that are not configured."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(t.lower(),) for t in taxonomy], "label string").distinct()
    seen = df.select(F.col(label).alias("label")).distinct()
    return wanted.join(seen, "label", "left_anti").withColumn("side", F.lit("missing")).union(seen.join(wanted, "label", "left_anti").withColumn("side", F.lit("unexpected")))


def score_histogram(df: DataFrame, score: str = "score") -> DataFrame:
    """(bucket, n, mean): five buckets of 0.2, the last one open above; empty buckets are there, mean is over all rows."""
    bucket = F.greatest(F.lit(0), F.least(F.lit(4), F.when(F.col(score) < 0.2, 0).when(F.col(score) < 0.4, 1).when(F.col(score) < 0.6, 2).when(F.col(score) < 0.8, 3).otherwise(4)))
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("c"), F.sum(score).alias("s"))
    total = counts.agg((F.sum("s") / F.sum("c")).alias("mean"))
    return df.sparkSession.range(5).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").crossJoin(F.broadcast(total)).select("bucket", F.coalesce("c", F.lit(0)).alias("n"), "mean")


def entity_coverage(df: DataFrame, output: str = "output") -> DataFrame:
    return df.select(F.explode(T.entities(F.col(output))).alias("e")).groupBy(F.col("e.type").alias("type")).agg(F.count("*").alias("n"))


def dataset_profile(train: DataFrame, evaluation: DataFrame, label: str = "label") -> DataFrame:
    both = train.select(F.lit(1).alias("t"), label).unionByName(evaluation.select(F.lit(0).alias("t"), label))
    return both.agg(F.sum("t").alias("train"), F.sum(1 - F.col("t")).alias("eval"), F.count("*").alias("total"), F.countDistinct(label).alias("classes"))


def weakest(df: DataFrame, score: str, name: str, n: int = 5) -> DataFrame:
    return df.orderBy(score, name).limit(n)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (k * count)."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(total)).select("label", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def majority_status(df: DataFrame, key: str, status: str) -> DataFrame:
    """(key, status, n) of the most frequent status, ties to the worse: error, fail, partial, pass."""
    worse = F.when(F.col(status) == "error", 0).when(F.col(status) == "fail", 1).when(F.col(status) == "partial", 2).otherwise(3)
    counts = df.groupBy(key, status).agg(F.count("*").alias("n")).withColumn("worse", worse)
    order = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "worse"))
    return counts.withColumn("k", order).where("k = 1").select(key, F.col(status).alias("status"), "n")
