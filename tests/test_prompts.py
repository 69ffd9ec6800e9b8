"""Prompt blocks and draws for prompts against plain versions."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tesserae.operators import generate, leading
from tesserae.operators.leading import leading_text


def test_first_characters_in_order(spark, monkeypatch):
    """A hot key over many tasks, ties, null places and keys, texts longer than the limit; few keys held at once."""
    monkeypatch.setattr(leading, "HELD_KEYS", 3)
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 9)) if rng.random() < 0.5 else 0, int(rng.integers(0, 200)) if rng.random() < 0.95 else None, "x" * int(rng.integers(0, 30)) + str(i)) for i in range(2000)]
    rows += [(None, 1, "null key"), (20, 1, None), (21, 2, "y" * 500), (22, 3, ""), (22, 4, "")]
    df = spark.createDataFrame(rows, "k int, place int, t string").repartition(13)
    got = {r["k"]: r["reference"] for r in leading_text(df, ["k"], "place", F.col("t"), "--", 120, "reference").collect()}
    want = {}
    for k in {r[0] for r in rows if r[2] is not None}:
        mine = sorted(((p is not None, p or 0), t[:120]) for key, p, t in rows if key == k and t is not None)
        want[k] = "--".join(t for _, t in mine)[:120]
    assert got == want
    assert leading_text(df.limit(0), ["k"], "place", F.col("t"), "--", 120, "reference").count() == 0


def test_draws_reach_the_whole_pool(spark):
    pool = spark.range(5000).select(F.concat(F.lit("s"), "id").alias("source"), F.col("id").cast("string").alias("content"))
    batches = spark.range(400).select(F.col("id").alias("batch"))
    got = generate._drawn(batches, pool, "source", 10, 3).collect()
    by = Counter(r["batch"] for r in got)
    assert set(by) == set(range(400)) and set(by.values()) == {10}
    assert len({(r["batch"], r["source"]) for r in got}) == 4000 and all(r["source"] == "s" + r["content"] for r in got)
    seen = Counter(r["source"] for r in got)
    assert abs(len(seen) / (5000 * (1 - np.exp(-0.8))) - 1) < 0.05  # as many unlike ones as uniform draws give
    assert abs(np.mean([int(s[1:]) for s in seen.elements()]) / 2500 - 1) < 0.05 and max(seen.values()) < 9
    again = generate._drawn(batches, pool.repartition(7), "source", 10, 3).collect()
    assert {(r["batch"], r["place"], r["source"]) for r in again} == {(r["batch"], r["place"], r["source"]) for r in got}


def test_few_and_repeated_rows(spark):
    pool = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", None), (None, "x")], "source string, content string")
    batches = spark.range(3).select(F.col("id").alias("batch"))
    got = generate._drawn(batches, pool, "source", 10, 0).collect()
    assert sorted((r["batch"], r["source"], r["content"]) for r in got) == sorted((b, s, c) for b in range(3) for s, c in (("a", "1"), ("b", None)))
    assert generate._drawn(batches, pool.limit(0), "source", 10, 0).count() == 0
