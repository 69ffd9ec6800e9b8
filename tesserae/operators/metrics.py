"""Evaluation metrics as aggregates over prediction rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.written import hidden


#: Rows of a group that its last step sorts, and parts into which a narrowing step cuts a group's range.
SORTED_ROWS, PARTS = 1_000_000, 4096


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str], own: list[str], part: Column) -> DataFrame:
    """state with each place's range cut to the part that holds it; `part` is a part's number, rising with the value."""
    value, share, lo, hi, index, below = own[len(keys) :]
    same = F.lit(True)
    for key, name in zip(keys, own, strict=False):
        same = same & F.col(key).eqNullSafe(F.col(name))
    inside = rows.join(state, same).where(F.col(value).between(F.col(lo), F.col(hi)))
    mine = [*own[: len(keys)], share, index, below]
    cut = inside.groupBy(*mine, part.alias("part")).agg(F.count("*").alias("c"), F.min(value).alias("least"), F.max(value).alias("most"))
    upto = F.sum("c").over(Window.partitionBy(*own[: len(keys)], share).orderBy("part")) + F.col(below)
    held = cut.withColumn("upto", upto).where((F.col("upto") > F.col(index)) & (F.col("upto") - F.col("c") <= F.col(index)))
    return held.select(*own[: len(keys)], share, index, F.col("least").alias(lo), F.col("most").alias(hi), (F.col("upto") - F.col("c")).alias(below))


def indexed_percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], prefix: str = "p", rounds: int | None = None) -> DataFrame:
    """The value at index min(floor(n p), n - 1) of each group in ascending order, exactly and without sorting a group.

    Each of `rounds` narrowing steps counts the rows of PARTS parts of the range that holds a place, in every task, and
    goes on with one part; what is left is counted by distinct value. Rounds are chosen by the row count so that a last
    step sorts SORTED_ROWS or so; of fewer rows all are counted by distinct value at once. Nulls are left out, a group of nulls alone is missing; null keys are a group. Numbers
    of any kind; NaN is the largest.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    if rounds is None:
        n, rounds = rows.count(), 0
        while n > SORTED_ROWS:
            n, rounds = n // PARTS, rounds + 1
    if not rounds:  # few rows: one shuffle of counts by distinct value
        c, upto, n = hidden(df.columns, "c", "upto", "n")
        w = Window.partitionBy(*keys)
        counts = rows.groupBy(*keys, value).agg(F.count("*").alias(c)).withColumn(upto, F.sum(c).over(w.orderBy(value))).withColumn(n, F.sum(c).over(w))
        at = lambda p: F.min(F.when(F.col(upto) > F.least(F.floor(F.col(n) * p), F.col(n) - 1), F.col(value)))
        return counts.groupBy(*keys).agg(*(at(p).alias(f"{prefix}{round(p * 100)}") for p in shares))
    own = hidden(df.columns, *(f"key{i}" for i in range(len(keys))), "share", "lo", "hi", "index", "below")
    own.insert(len(keys), value)
    share, lo, hi, index, below = own[len(keys) + 1 :]
    sizes = rows.groupBy(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=False))).agg(F.count("*").alias("n"), F.min(value).alias(lo), F.max(value).alias(hi))
    state = sizes.withColumn(share, F.explode(F.array(*map(F.lit, shares)))).withColumn(below, F.lit(0).cast("long"))
    state = state.withColumn(index, F.least(F.floor(F.col("n") * F.col(share)), F.col("n") - 1)).drop("n")
    at = (F.col(value) - F.col(lo)).cast("double") / (F.col(hi) - F.col(lo)).cast("double") * PARTS
    part = F.when(F.col(hi) > F.col(lo), F.least(F.floor(F.nanvl(at, F.lit(float(PARTS)))), F.lit(PARTS - 1))).otherwise(0)
    for _ in range(rounds):
        state = _narrowed(rows, state, keys, own, part)
    found = _narrowed(rows, state, keys, own, F.col(value))
    named = found.groupBy(*(F.col(o).alias(k) for k, o in zip(keys, own, strict=False)))
    return named.agg(*(F.max(F.when(F.col(share) == p, F.col(lo))).alias(f"{prefix}{round(p * 100)}") for p in shares))


def latency_summary(df: DataFrame, keys: list[str], latency: str = "latency_ms", ttft: str = "ttft_ms", itl: str = "itl_ms", rate: str = "tok_s", rounds: int | None = None) -> DataFrame:
    """Latencies (avg, min, max, p50, p95, p99) by key, percentiles of the positive times to a first token and between
    tokens, and the mean positive rate; one decimal, and 0 where there is nothing to measure.
    """
    stats = df.groupBy(*keys).agg(F.count(latency).alias("n"), F.avg(latency).alias("avg"), F.min(latency).alias("min"), F.max(latency).alias("max"), F.avg(F.when(F.col(rate) > 0, F.col(rate))).alias("tok_s_avg"))
    kind, at = hidden(df.columns, "kind", "at")
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    kinds = {"": F.col(latency), "ttft_": positive(ttft), "itl_": positive(itl)}
    each = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias(kind), c.cast("double").alias(at)) for k, c in kinds.items()))).alias("e")).select(*keys, f"e.{kind}", f"e.{at}")
    found = indexed_percentiles(each, [*keys, kind], at, [0.5, 0.95, 0.99], rounds=rounds)
    wanted = [("", 50), ("", 95), ("", 99), ("ttft_", 50), ("ttft_", 95), ("itl_", 50), ("itl_", 95)]
    wide = found.groupBy(*keys).agg(*(F.max(F.when(F.col(kind) == k, F.col(f"p{p}"))).alias(f"{k}p{p}") for k, p in wanted))
    own = hidden(stats.columns, *(f"key{i}" for i in range(len(keys))))
    same = F.lit(True)
    for key, name in zip(keys, own, strict=True):
        same = same & F.col(key).eqNullSafe(F.col(name))
    both = stats.join(wide.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), *(f"{k}p{p}" for k, p in wanted)), same, "left").drop(*own)
    return both.select(*keys, "n", *(F.coalesce(F.bround(c, 1), F.lit(0.0)).alias(c) for c in both.columns if c not in (*keys, "n")))


def confusion(df: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """(label, tp, fp, fn, support) of every gold label."""
    pairs = df.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").alias("c"))
    gold_side = pairs.groupBy(F.col("g").alias("label")).agg(F.sum(F.when(F.col("g") == F.col("p"), F.col("c")).otherwise(0)).alias("tp"), F.sum("c").alias("support"))
    other = pairs.groupBy(F.col("p").alias("label")).agg(F.sum("c").alias("claimed"))
    return gold_side.join(other, "label", "left").select("label", "tp", (F.coalesce("claimed", F.lit(0)) - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), "support")


def per_class(df: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """(label, precision, recall, f1, support); a division by zero gives 0."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), b), F.lit(0.0))
    c = confusion(df, gold, predicted)
    return c.select("label", share("tp", F.col("tp") + F.col("fp")).alias("precision"), share("tp", F.col("support")).alias("recall"), F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"), "support")


def accuracy(df: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    right = F.sum((F.col(gold) == F.col(predicted)).cast("long"))
    return df.agg(right.alias("correct"), F.count("*").alias("total"), F.try_divide(right, F.count("*")).alias("accuracy"))


def regression(df: DataFrame, gold: str, predicted: str, lo: float, hi: float, train_mean: float) -> DataFrame:
    """MAE, RMSE, R2 and Pearson of clipped predictions, and the MAE of always saying the training mean."""
    clipped = df.select(F.col(gold).alias("y"), F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(predicted))).alias("p"))
    e = F.col("y") - F.col("p")
    s = clipped.agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("res"), F.var_pop("y").alias("var"), F.count("*").alias("n"),
        F.stddev_pop("y").alias("sy"), F.stddev_pop("p").alias("sp"), F.corr("y", "p").alias("corr"), F.avg(F.abs(F.col("y") - train_mean)).alias("baseline_mae"),
    )
    r2 = F.when(F.col("n") > 1, 1 - F.try_divide(F.col("res"), F.col("var") * F.col("n"))).otherwise(0.0)
    return s.select("mae", "rmse", r2.alias("r2"), F.when((F.col("sy") > 1e-9) & (F.col("sp") > 1e-9), F.col("corr")).otherwise(0.0).alias("pearson"), "baseline_mae")


def entity_metrics(gold: DataFrame, predicted: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(type, tp, fp, fn, precision, recall, f1) for each gold type and for all together (type null) of (doc, type, text)."""
    keys = [doc, "type", "text"]
    both = gold.select(*keys).distinct().withColumn("g", F.lit(1)).join(predicted.select(*keys).distinct().withColumn("p", F.lit(1)), keys, "full_outer")
    flags = both.select("type", F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    counts = flags.rollup("type").agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum((1 - F.col("g")) * F.col("p")).alias("fp"), F.sum(F.col("g") * (1 - F.col("p"))).alias("fn")).where("type is null or tp + fn > 0")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("type", "tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def retrieval_metrics(ranked: DataFrame, query: str, rank: str, hit: str, ks=(1, 5, 10)) -> DataFrame:
    """recall@k and MRR from ranked hits; a query without a hit counts 0."""
    best = ranked.groupBy(query).agg(F.min(F.when(F.col(hit), F.col(rank))).alias("r"))
    return best.agg(*(F.avg(F.coalesce(F.col("r") <= k, F.lit(False)).cast("double")).alias(f"recall_{k}") for k in ks), F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"), F.count("*").alias("queries"))


def logprob_confidence(df: DataFrame, key: str, pos: str, token: str, logprob: str) -> DataFrame:
    """100 * the geometric mean probability of the answer's first line, one decimal; -1 where nothing is kept.

    Tokens up to the last closing think tag and blank tokens are skipped; it stops at the first newline after a kept one.
    """
    w = Window.partitionBy(key)
    started = F.coalesce(F.max(F.when(F.contains(F.col(token), F.lit("</think>")), F.col(pos))).over(w), F.lit(-1))
    rows = df.withColumn("_after", F.col(pos) > started).withColumn("_kept", F.col("_after") & (F.length(F.regexp_replace(token, r"\s", "")) > 0))
    first = F.min(F.when(F.col("_kept"), F.col(pos))).over(w)
    stop = F.min(F.when(F.col("_after") & F.contains(F.col(token), F.lit("\n")) & (F.col(pos) > F.col("_first")), F.col(pos))).over(w)
    rows = rows.withColumn("_first", first).withColumn("_stop", stop)
    used = F.col("_kept") & (F.col("_stop").isNull() | (F.col(pos) < F.col("_stop")))
    return rows.groupBy(key).agg(F.coalesce(F.round(100 * F.exp(F.avg(F.when(used, F.col(logprob)))), 1), F.lit(-1.0)).alias("confidence"))
