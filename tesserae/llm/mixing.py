"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import hidden

#: Above this many sources their rates are joined, not broadcast; so are texts that repeat under one doc_id.
BROADCAST_SOURCES, BROADCAST_REPEATED = 10_000, 200_000
SALTS = 64


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to where the rest is far below the spacing of doubles; summed from logarithms."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    zero = F.struct(F.expr("cast(array() as array<double>)").alias("cdf"), (-rate).alias("log"), F.lit(0.0).cast("double").alias("sum"))
    step = lambda s, k: F.struct(
        F.concat(s["cdf"], F.array(s["sum"] + F.exp(s["log"]))).alias("cdf"),
        (s["log"] + F.log(rate) - F.log(k + F.lit(1.0))).alias("log"),
        (s["sum"] + F.exp(s["log"])).alias("sum"),
    )
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(0), top), zero, step, lambda s: s["cdf"])).otherwise(F.expr("array(1D)"))


def uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the seed and the columns' text."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, exponent: float = 0.5, total: int | None = None, seed: int = 7, sources: int = BROADCAST_SOURCES, copy: str = "copy", repeated: int = BROADCAST_REPEATED) -> DataFrame:
    """docs with each row repeated X times, X a Poisson number of mean rate(source), in one global random order.

    weights gives the target share of each source (others get 0); without it a source of n rows weighs n ** exponent.
    rate = total * share / n; total is the number of rows unless given. X comes from a uniform number hashed from seed,
    doc_id and text, so it is the same on every run. Rows that repeat both (whether they have a doc_id or not) draw each
    for itself: their numbers are hashed from their places in the input too. A null source is a source.
    The column named by `copy` counts a row's repetitions from 1 and replaces one of that name; all others stay.
    Null and empty texts are rows like others; an empty table gives an empty one, and so do weights that are all 0.
    Rates are per source, so no row is shuffled by its source; the one shuffle deals rows out by a hash of doc_id and
    copy. `sources` is the number of sources up to which their rates are broadcast; more are joined by salted keys. Up
    to `repeated` repeated pairs of doc_id and text are broadcast, more are joined.
    """
    docs = docs.drop(copy)
    own, salt, cdf, times, order, same, place, ident, which = hidden([*docs.columns, copy], "key", "salt", "cdf", "times", "order", "same", "place", "ident", "which")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    sizes = docs.groupBy(key.alias(own)).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow("n", F.lit(exponent))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col(own) == ("null" if name is None else f"s{name}"), F.lit(float(w))).otherwise(weight)
    sizes = sizes.withColumn("w", weight)
    both = sizes.agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("sources")).first()
    if not both["n"] or not both["w"]:
        return docs.withColumn(copy, F.lit(1)).limit(0)
    rates = sizes.select(own, poisson_cdf(F.lit(float(total or both["n"]) / both["w"]) * F.col("w") / F.col("n")).alias(cdf))
    rows = docs.withColumn(own, key)
    if both["sources"] <= sources:
        rows = rows.join(F.broadcast(rates), own)
    else:
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = F.pmod(F.xxhash64("doc_id", *(["text"] if "text" in docs.columns else [])), F.lit(SALTS)).cast("int")
        rows = rows.withColumn(salt, dealt).join(salted, [own, salt]).drop(salt)
    text = ["text"] if "text" in docs.columns else []
    rows = rows.withColumn(same, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")) if text else F.lit(""))
    more = rows.groupBy("doc_id", same).count().where("count > 1").select(F.col("doc_id").alias(ident), F.col(same).alias(which))
    more = F.broadcast(more) if more.limit(repeated + 1).count() <= repeated else more
    rows = rows.withColumn(place, F.monotonically_increasing_id()).join(more, F.col("doc_id").eqNullSafe(F.col(ident)) & (F.col(same) == F.col(which)), "left")
    rows = rows.withColumn(place, F.when(F.col(which).isNotNull(), F.col(place) + 1).otherwise(0))
    u = uniform(seed, "doc_id", same, place)
    rows = rows.withColumn(times, F.size(F.filter(cdf, lambda c: c <= u))).where(F.col(times) > 0)
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    rows = rows.withColumn(order, F.xxhash64(F.lit(seed), "doc_id", same, place, copy)).drop(cdf, own, times, same, place, ident, which)
    return rows.repartition(order).sortWithinPartitions(order).drop(order)
