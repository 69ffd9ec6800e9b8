"""The tolerant as-of join against a plain version: ties, hot keys over many partitions, odd rows, zones."""

import math
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import asof_join as module
from tesserae.llm.asof_join import asof_join, clicks_to_orders

RANK = "struct<grade:long,against:long,note:string>"


def best_of(group):
    return max(group, key=lambda r: tuple((x is not None, x) for x in r))


def expected(events, orders, tolerance):
    by_key = defaultdict(lambda: defaultdict(list))
    for key, at, rank in orders:
        if key is not None and at is not None:
            by_key[key][at].append(rank)
    out = []
    for ident, key, at in events:
        times = [t for t in by_key.get(key, ()) if at is not None and at - tolerance <= t <= at]
        group = by_key[key][max(times)] if times else []
        out.append((ident, key, at, max(times), *best_of(group), len(group)) if times else (ident, key, at, None, None, None, None, 0))
    return sorted(map(repr, out))


def found(spark, events, orders, tolerance, partitions):
    e = spark.createDataFrame(events, "id long, key long, at long").withColumns({c: F.lit("own") for c in ("rank", "tag", "matched", "n_tied")}).repartition(5)
    o = spark.createDataFrame(orders, f"key long, at long, rank {RANK}").withColumns({c: F.lit("own") for c in ("id", "number", "best")}).repartition(4)
    return sorted(repr(tuple(r)) for r in asof_join(e, o, tolerance, partitions).collect())


@pytest.mark.parametrize("partitions", [1, 7, 40])
@pytest.mark.parametrize("span", [3, 60, 5000])
def test_like_a_plain_join(spark, partitions, span, monkeypatch):
    """A third of all rows has one key; few times make large tie groups that several partitions share."""
    monkeypatch.setattr(module, "SAMPLED", 500)
    rng = np.random.default_rng(partitions + span)
    keys = [7 if rng.random() < 0.35 else int(k) for k in rng.integers(-3, 12, 1500)]
    events = [(i, k, int(t)) for i, (k, t) in enumerate(zip(keys[:900], rng.integers(-span, span, 900), strict=True))]
    orders = [(k, int(t), (None if g == 0 else int(g), int(a), None if a % 3 else f"n{a}")) for k, t, g, a in zip(keys[900:], rng.integers(-span, span, 600), rng.integers(0, 4, 600), rng.integers(0, 40, 600), strict=True)]
    orders += orders[:50] + [(None, 1, (9, 9, None)), (7, None, (9, 9, None)), (7, 0, (None, None, None))]
    odd = [(9001, None, 5), (9002, 7, None), (9003, None, None), (9004, 99, 5), (None, 7, 3), (None, 7, 2)]
    want = expected(events + odd, orders, span // 2)
    assert found(spark, events + odd + events[:30] + [(None, 7, 2), (9001, None, 5)], orders, span // 2, partitions) == want


def test_unlike_copies_and_empty_tables(spark):
    order = [(1, 5, (1, 1, "x"))]
    assert found(spark, [(3, None, 9), (3, 1, 8), (3, 1, 6), (3, 2, 6)], order, 10, 3) == [repr((3, 1, 6, 5, 1, 1, "x", 1))]
    assert found(spark, [], order, 10, 3) == [] and found(spark, [(1, 1, 9)], [], 10, 3) == [repr((1, 1, 9, None, None, None, None, 0))]
    assert found(spark, [(1, 1, 15), (2, 1, 16), (4, 1, 5), (5, 1, 4)], order, 10, 3) == expected([(1, 1, 15), (2, 1, 16), (4, 1, 5), (5, 1, 4)], order, 10)


def shop():
    """Clicks and sales with whole days, ties, nulls, copies and times before 1970."""
    rng, zero = np.random.default_rng(5), datetime(2024, 3, 30)
    at = lambda: zero + timedelta(days=int(rng.integers(0, 4)), microseconds=int(rng.integers(0, 3)) * 28_800_000_001)
    clicks = [(i, at() if i % 11 else None, int(rng.integers(0, 3)) if i % 13 else None) for i in range(200)] + [(500, datetime(1969, 12, 31, 23, 59, 59, 999999), 1)]
    sales = [(i, int(rng.integers(0, 3)) if i % 17 else None, float(rng.integers(0, 9999)) / 100 if i % 5 else [None, math.nan, math.inf][i % 3], at(), int(rng.integers(1, 6)) if i % 7 else None) for i in range(150)]
    return clicks + clicks[:20], sales + [(900, 1, 1.005, datetime(1969, 12, 31), 3), (None, 1, 2.0, zero, 2), sales[3]]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_clicks_to_orders(spark, zone):
    clicks, sales = shop()
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        c = spark.createDataFrame(clicks, "click_id long, ts timestamp_ntz, client_id long")
        s = spark.createDataFrame(sales, "sale_id long, client_id long, total double, sold_at timestamp_ntz, priority int")
        got = sorted(repr(tuple(r)) for r in clicks_to_orders(c, s).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    day, crc = 86_400_000_000, lambda i: zlib.crc32(str(i).encode())

    def used(ident, t):
        t = None if t is None else (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
        return t - t % day if ident is not None and t is not None and crc(ident) % 2 else t

    orders = []
    for ident, client, total, at, priority in sales:
        cents = math.floor(100 * total + 0.5) if total is not None and math.isfinite(total) else None
        orders.append((client, used(ident, at), (priority, None if ident is None else ~ident, cents)))
        if ident is not None and crc(ident) % 3:
            orders.append((client, used(ident, at), (None if priority is None else 6 - priority, ident, cents)))
    events = {i: (i, k, used(i, t)) for i, t, k in clicks}
    want = [eval(x) for x in expected(events.values(), orders, 3 * day)]
    assert got == sorted(repr((i, k, t, None if a is None else ~a, None if m is None else t - m, c, n)) for i, k, t, m, _, a, c, n in want)
