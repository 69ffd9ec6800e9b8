"""Tolerant as-of join: each event meets the latest order of its key within a tolerance, by one sorted merge."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that are sampled for each partition's bound.
SAMPLED = 64


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone counts as UTC, whatever the session's zone."""
    if df.schema[column].dataType == T.TimestampType():
        return F.unix_micros(column)
    within = F.rint(F.expr(f"cast(extract(second from `{column}`) as double)") * 1e6).cast("long") % 1_000_000
    second = F.unix_timestamp(column)  # before 1970 rounded up
    up = (second <= 0) & (within > 0) & (F.pmod(second, F.lit(60)) != F.second(column))
    return F.when(up, second - 1).otherwise(second) * 1_000_000 + within


def _rank(best: tuple) -> tuple:
    return tuple((x is not None, x) for x in best)


def joined(a: tuple, b: tuple) -> tuple:
    """Of two parts (number, best) of one tie group the whole."""
    return a[0] + b[0], a[1] if a[1] == b[1] or _rank(a[1]) > _rank(b[1]) else b[1]


def deal_events(bounds: list[tuple]):
    """Rows (key, at, tag, id) with the partition that holds them; equal keys and times are dealt by tag.

    Composite keys are (key, twice the time and 1 for events, partition): orders sort before events of the same time.
    """

    def deal(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, at, tag, ident in rows:
            yield (key, 2 * at + 1, bisect_right(bounds, (key, at, 1, tag))), ident

    return deal


def deal_orders(bounds: list[tuple], tolerance: int):
    """Rows (key, at, number, best) with the partition that holds them, and what later partitions must know of them.

    A partition that begins amid a key's rows may match the tie group that ends an earlier one. A task remembers, for each
    partition, the latest tie group that it sent there of the key that goes on in the next: at its end it sends on what is
    still within the tolerance of a bound. That is one row for each bound at most, however many rows the key has.
    """

    def deal(rows: Iterator[tuple]) -> Iterator[tuple]:
        last: dict[int, tuple] = {}
        for key, at, number, best in rows:
            p = bisect_right(bounds, (key, at, 0, 0))
            group = (number, tuple(best))
            if p < len(bounds) and bounds[p][0] == key:
                have = last.get(p)
                if have is None or at > have[0]:
                    last[p] = (at, group)
                elif at == have[0]:
                    last[p] = (at, joined(have[1], group))
            yield (key, 2 * at, p), group
        carried = None
        for p, bound in enumerate(bounds):
            if p and bounds[p - 1][0] != bound[0]:
                carried = None
            here = last.get(p)
            if here and carried and here[0] == carried[0]:
                carried = (here[0], joined(carried[1], here[1]))
            elif here:
                carried = here
            if carried and bound[1] - carried[0] > tolerance:
                carried = None
            if carried:
                yield (bound[0], 2 * carried[0], p + 1), carried[1]

    return deal


def merge(tolerance: int, width: int):
    """One sorted pass over a partition that holds nothing but the current key's latest tie group."""
    nothing = (None,) * (width + 1) + (0,)

    def match(rows: Iterator[tuple]) -> Iterator[tuple]:
        key = at = group = None
        for (k, when, _), value in rows:
            t = when >> 1
            if when & 1:
                if group is not None and k == key and t - at <= tolerance:
                    yield (value, k, t, at, *group[1], group[0])
                else:
                    yield (value, k, t, *nothing)
            elif group is not None and k == key and t == at:
                group = joined(group, value)
            else:
                key, at, group = k, t, value

    return match


def _bounds(keys: DataFrame, rows: int, partitions: int) -> list[tuple]:
    """Keys between partitions of like numbers of rows, from a sample of SAMPLED keys for each of them."""
    if partitions < 2 or not rows:
        return []
    sample = sorted(tuple(r) for r in keys.sample(min(1.0, SAMPLED * partitions / rows), 11).where("key is not null and at is not null").collect())
    return sorted({sample[i * len(sample) // partitions] for i in range(1, partitions)}) if sample else []


def asof_join(events: DataFrame, orders: DataFrame, tolerance: int, partitions: int | None = None) -> DataFrame:
    """(id, key, at, matched, the fields of rank, n_tied) of each event with the latest order of its key.

    events(id, key, at) and orders(key, at, rank): `at` are longs, the order must be at or before the event and at most
    `tolerance` earlier. Of orders at one time the one with the largest rank is matched (a struct of integers or strings;
    null is least; the fields decide from left to right, orders equal in all are alike), and n_tied counts them all.

    Both sides are dealt to partitions by ranges of (key, at), so that a key with a third of all rows spans many of them,
    and each partition is sorted and merged as a stream that holds one tie group. Orders of one key and time are counted
    before they are dealt. The driver sees a bounded sample of keys, SAMPLED for each partition.

    Events that repeat an id count once: the earliest of those with key and time; without an id, each unlike row. Events
    without key or time match nothing and stay (matched and the fields are null, n_tied 0); orders without one go. Other
    columns are ignored; empty tables give no rows, or no matches.
    """
    spark = events.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    events, orders = events.select("id", "key", "at"), orders.select("key", "at", "rank")
    rows = events.count() + orders.count()
    fields = orders.schema["rank"].dataType.fields
    tag = F.hash("id")
    bounds = _bounds(events.select("key", "at", F.lit(1), tag).union(orders.select("key", "at", F.lit(0), F.lit(0))), rows, partitions)
    once = events.groupBy("id", F.when(F.col("id").isNull(), F.struct("key", "at")).alias("unlike")).agg(F.expr("min_by(struct(key, at), struct(key is null or at is null, at, key))").alias("e")).select("id", "e.key", "e.at")
    counted = orders.where("key is not null and at is not null").groupBy("key", "at").agg(F.count("*").alias("number"), F.max("rank").alias("best"))
    left = once.where("key is not null and at is not null").select("key", "at", tag, "id").rdd.mapPartitions(deal_events(bounds))
    right = counted.rdd.mapPartitions(deal_orders(bounds, tolerance))
    dealt = left.union(right).repartitionAndSortWithinPartitions(len(bounds) + 1, lambda key: key[2])
    kinds = {f.name: f.dataType for f in events.schema.fields}
    schema = T.StructType([T.StructField(n, kinds[n]) for n in ("id", "key", "at")] + [T.StructField("matched", T.LongType())] + [T.StructField(f.name, f.dataType) for f in fields] + [T.StructField("n_tied", T.LongType())])
    found = spark.createDataFrame(dealt.mapPartitions(merge(tolerance, len(fields))), schema, verifySchema=False)
    never = once.where("key is null or at is null").select("id", "key", "at", F.lit(None).cast("long"), *(F.lit(None).cast(f.dataType) for f in fields), F.lit(0).cast("long"))
    return found.union(never)


def clicks_to_orders(clicks: DataFrame, sales: DataFrame) -> DataFrame:
    """The shop's clicks with the order each is owed to, under the rules of the query op11.

    Half of the times (by the id's crc32) are known to the day only; two sales of three have a second order. Totals that
    are null or not finite give no total_cents.
    """
    day = 86_400_000_000

    def used(df: DataFrame, ident: str, at: str) -> Column:
        t = micros(df, at)
        return F.when(F.crc32(F.col(ident).cast("string").cast("binary")) % 2 == 1, t - F.pmod(t, F.lit(day))).otherwise(t)

    events = clicks.select(F.col("click_id").cast("long").alias("id"), F.col("client_id").cast("long").alias("key"), used(clicks, "click_id", "ts").alias("at"))
    cents = F.when(F.abs("total") < float("inf"), F.floor(100 * F.col("total") + F.lit(0.5)))
    first = sales.select(F.col("client_id").cast("long").alias("key"), used(sales, "sale_id", "sold_at").alias("at"), F.col("sale_id").cast("long").alias("sale_id"), F.col("priority").cast("long").alias("priority"), cents.cast("long").alias("cents"), (F.crc32(F.col("sale_id").cast("string").cast("binary")) % 3 != 0).alias("twice"))
    both = first.withColumn("p", F.explode(F.expr("case when twice then array(struct(priority, sale_id), struct(6 - priority as priority, ~sale_id as sale_id)) else array(struct(priority, sale_id)) end")))
    orders = both.select("key", "at", F.struct(F.col("p.priority").alias("priority"), F.expr("~p.sale_id").alias("against"), "cents").alias("rank"))
    found = asof_join(events, orders, 72 * 3_600_000_000)
    return found.select(
        F.col("id").alias("click_id"), F.col("key").alias("client_id"), F.col("at").alias("ts_us"), F.expr("~against").alias("sale_id"), (F.col("at") - F.col("matched")).alias("lag_us"), F.col("cents").alias("total_cents"), "n_tied"
    )
