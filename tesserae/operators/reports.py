"""Report aggregates: distributions in order, weakest groups, deltas between runs, training curves, prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import truncated
from tesserae.operators.metrics import indexed_percentiles
from tesserae.operators.profile import label_profile

#: Rows that a report shows of predictions, of a baseline's and of a distribution.
SHOWN = 15


def low_labels(df: DataFrame, label: str = "label", least: int = 50) -> DataFrame:
    """(label, n) of the labels with fewer than `least` rows."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).where(F.col("n") < least)


def ordered_distribution(df: DataFrame, label: str, order: str) -> DataFrame:
    """(label, n, place): most frequent first, of equally frequent ones the one that comes first in the data."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    return counts.select("label", "n", F.row_number().over(Window.orderBy(F.desc("n"), "seen")).alias("place"))  # a row a label


def review(train: DataFrame, evaluation: DataFrame, label: str = "label", least: int = 50) -> DataFrame:
    """(label, n, pct, low) over both sets together, pct in percent; low marks labels with fewer than `least` rows."""
    both = train.select(label).unionByName(evaluation.select(label))
    return label_profile(both, label, least).withColumn("pct", F.col("pct") * 100)


def weakest_categories(df: DataFrame, category: str, gold: str, predicted: str, least: int = 2, n: int = 5) -> DataFrame:
    """(category, total, correct, accuracy) of the n least accurate categories with `least` rows or more; ties by name."""
    right = F.sum((F.col(gold) == F.col(predicted)).cast("long"))
    by = df.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("total"), right.alias("correct"), (right / F.count("*")).alias("accuracy"))
    return by.where(F.col("total") >= least).orderBy("accuracy", "category").limit(n)


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """(classes): the distinct values in one sorted array; a class is a label, so there are few."""
    return df.select(column).distinct().agg(F.array_sort(F.collect_list(column)).alias("classes"))


def judged(df: DataFrame, confidence: str = "confidence", correct: str = "correct") -> DataFrame:
    """(accuracy in percent, mean of the confidences that are known, i.e. not negative, one decimal; 0 where none is)."""
    return df.agg(
        F.coalesce(F.avg(F.col(correct).cast("double")) * 100, F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.bround(F.avg(F.when(F.col(confidence) >= 0, F.col(confidence))), 1), F.lit(0.0)).alias("confidence"),
    )


def run_seconds(df: DataFrame, key: str, seconds: str = "seconds") -> DataFrame:
    """(key, seconds): the time of all runs of a case, one decimal."""
    return df.groupBy(key).agg(F.bround(F.sum(seconds), 1).alias("seconds"))


def dynamic_max_tokens(df: DataFrame, output: str = "output") -> DataFrame:
    """(avg_chars, max_tokens): 1.5 times the 95th percentile of four-character tokens, 32 at least.

    Without any output it is 512 where outputs have more than 50 characters on average, else 32.
    """
    rows = df.select(F.coalesce(output, F.lit("")).alias("o")).select(F.length("o").alias("n"))
    average = rows.agg(F.coalesce(F.sum("n") / F.greatest(F.count("*"), F.lit(1)), F.lit(0.0)).alias("avg_chars"))
    p95 = indexed_percentiles(rows.where("n > 0").select(F.lit(0).alias("k"), F.floor(F.col("n") / 4).alias("t")), ["k"], "t", [0.95])
    tokens = F.when(F.col("p95").isNotNull(), F.greatest(F.lit(32), F.floor(F.col("p95") * 1.5))).otherwise(F.when(F.col("avg_chars") > 50, 512).otherwise(32))
    return average.join(F.broadcast(p95), F.lit(True), "left").select("avg_chars", tokens.cast("long").alias("max_tokens"))


def points_gained(base: Column, tuned: Column) -> Column:
    """The gain of a share in points, as `+1.2 pts`."""
    d = (tuned - base) * 100
    return F.concat(F.when(d >= 0, "+").otherwise(""), F.format_string("%.1f pts", F.bround(d, 1)))


def percent_better(base: Column, value: Column, lower_is_better: bool) -> Column:
    """How much better than a baseline a value is, in percent of the baseline; null without one."""
    gain = (base - value) if lower_is_better else (value - base)
    return F.when(base > 0, gain / base * 100)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in this order."""
    row = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("row")).select("row.*")


def head_rows(df: DataFrame, order: list[str], n: int = SHOWN) -> DataFrame:
    return df.orderBy(*order).limit(n)


def latest_checkpoint(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, step) of the checkpoint folder with the most steps among checkpoint-N; empty where there is none."""
    step = F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"(?:^|/)checkpoint-(\d+)$", 1).try_cast("long")
    return paths.select(path, step.alias("step")).where("step is not null").orderBy(F.desc("step"), path).limit(1)


def training_curve(log: DataFrame) -> DataFrame:
    """One row of log(step, loss, eval_loss): numbers of losses, the first, last and least, four decimals."""
    known = F.col("loss").isNotNull()
    at = lambda pick: F.bround(pick(F.when(known, F.col("loss")), F.when(known, F.col("step"))), 4)
    return log.agg(
        F.count("loss").alias("losses"), F.count("eval_loss").alias("eval_losses"), at(F.min_by).alias("start_loss"),
        at(F.max_by).alias("final_loss"), F.bround(F.min("loss"), 4).alias("min_loss"), F.max("step").alias("total_steps"),
    )


def cheapest(prices: DataFrame, fallback: float) -> DataFrame:
    """(hourly): the least of the instance types' last prices(instance, at, price), or the fallback where none is known."""
    last = prices.groupBy("instance").agg(F.max_by("price", "at").alias("price"))
    return last.agg(F.coalesce(F.min("price"), F.lit(fallback)).alias("hourly"))


def preview(train: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """The first n training rows as one line each: instruction cut to 80 characters, input to 120, the output whole."""
    rows = head_rows(train, order, n)
    return rows.select(*order, truncated(F.col("instruction"), 80).alias("instruction"), truncated(F.col("input"), 120).alias("input"), "output")
