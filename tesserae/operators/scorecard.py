"""Scorecards: statuses from flags, comparison with a baseline, folds of event streams, capacity formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of statuses in comparisons with a baseline.
ORDINAL = {"fail": 0, "error": 0, "partial": 1, "pass": 2}


def status(failed: Column, weak: Column) -> Column:
    return F.when(failed, "fail").when(weak, "partial").otherwise("pass")


def forbidden(answer: Column, phrases: Column) -> Column:
    """The phrases that the answer contains, whatever their case."""
    return F.filter(phrases, lambda p: F.contains(F.lower(answer), F.lower(p)))


def ordinal(c: Column) -> Column:
    out = F.lit(0)
    for name, value in ORDINAL.items():
        out = F.when(c == name, value).otherwise(out)
    return out


def diff_baseline(rows: DataFrame, base: DataFrame, key: str = "id") -> DataFrame:
    """(key, status, was, change) of the rows that the baseline has and whose status changed rank."""
    both = rows.select(key, "status").join(base.select(key, F.col("status").alias("was")), key)
    d = ordinal(F.col("status")) - ordinal(F.col("was"))
    return both.withColumn("change", F.when(d < 0, "regression").when(d > 0, "improvement")).where("change is not null")


def fold_events(df: DataFrame, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """(run, answer, model, n) of event rows (type, text): text since the last reset up to the end mark; last model."""
    w = Window.partitionBy(run)
    end = F.min(F.when(F.col("type") == "done", F.col(seq))).over(w)
    rows = df.withColumn("_end", end).where(F.col("_end").isNull() | (F.col(seq) < F.col("_end")))
    rows = rows.withColumn("_reset", F.coalesce(F.max(F.when(F.col("type") == "answer_reset", F.col(seq))).over(w), F.lit(-1)))
    kept = F.when(F.col("type").isin("token", "response") & (F.col(seq) > F.col("_reset")), F.struct(seq, "text"))
    parts = F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["text"])
    return rows.groupBy(run).agg(F.array_join(parts, "").alias("answer"), F.max_by(F.when(F.col("type") == "model", F.col("text")), F.when(F.col("type") == "model", F.col(seq))).alias("model"), F.count("*").alias("n"))


#: Hours of a month, on-demand over spot prices and throughput over that of CPUs, prices where none is known.
MONTH_HOURS = 730
ON_DEMAND, THROUGHPUT, FALLBACK = {"cpu": 2.5, "gpu": 3.0}, {"cpu": 1, "gpu": 15}, {"cpu": 0.16, "gpu": 0.50}
VOLUMES = (1_000, 10_000, 100_000, 1_000_000)


def cost_tiers(stats: DataFrame, prices: DataFrame) -> DataFrame:
    """(daily, rps_needed, cpu_replicas, cpu_od, cpu_spot, gpu_replicas, gpu) for four volumes of requests a day.

    stats(avg) has one row with the mean latency in ms (0: one request a second); prices(cpu, gpu) one with the least
    spot prices an hour, null where none is known. Hourly on-demand prices are rounded to three decimals, months to two.
    """
    spot = {k: F.coalesce(F.col(k), F.lit(FALLBACK[k])) for k in ("cpu", "gpu")}
    month = {k: F.bround(F.bround(spot[k] * ON_DEMAND[k], 3) * MONTH_HOURS, 2) for k in spot}
    rate = F.when(F.col("avg") > 0, 1000 / F.col("avg")).otherwise(1.0)
    tiers = stats.sparkSession.createDataFrame([(v,) for v in VOLUMES], "daily long")
    needed = F.col("daily") / 86400
    replicas = {k: F.greatest(F.lit(1), F.ceil(needed / (rate * THROUGHPUT[k]))).cast("long") for k in spot}
    return tiers.join(F.broadcast(stats.select("avg").join(prices.select("cpu", "gpu"), F.lit(True))), F.lit(True)).select(
        "daily",
        F.bround(needed, 2).alias("rps_needed"),
        replicas["cpu"].alias("cpu_replicas"),
        F.bround(month["cpu"] * replicas["cpu"], 2).alias("cpu_od"),
        F.bround(F.bround(spot["cpu"] * MONTH_HOURS, 2) * replicas["cpu"], 2).alias("cpu_spot"),
        replicas["gpu"].alias("gpu_replicas"),
        F.bround(month["gpu"] * replicas["gpu"], 2).alias("gpu"),
    )


def context_window(most: Column, free: Column) -> Column:
    return F.when(free, F.greatest(F.lit(8192), 4 * most)).otherwise(F.when(most > 0, F.greatest(F.lit(512), 3 * most)).otherwise(512))


def token_budget(p95: Column, average: Column, free: Column) -> tuple[Column, Column]:
    """Most output tokens (a fifth above p95), and half the average for reasoning where the form is free."""
    return p95 + F.floor(p95 / 5), F.when(free, F.floor(average / 2)).otherwise(0)


def latency(tokens_in: Column, tokens_out: Column, prompt_rate: Column, ms_each: Column) -> Column:
    return tokens_in / prompt_rate + tokens_out * ms_each / 1000
