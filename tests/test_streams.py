"""Streams against the batch versions of what they compute."""

import shutil
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import scorecard
from tesserae.streaming.runs import fold_to, folded

SCHEMA = "run_id long, seq long, type string, text string, ts timestamp"


def run_events():
    rng, zero = np.random.default_rng(3), datetime(2024, 1, 1)
    rows = []
    for run in range(12):
        n = int(rng.integers(1, 40))
        kinds = rng.choice(["token", "response", "model", "answer_reset", "other"], n, p=[0.6, 0.1, 0.1, 0.1, 0.1])
        kinds = list(kinds) if run % 3 else [*kinds, "done", "token", "answer_reset", "model"]
        rows += [(run, i, k, None if i % 13 == 5 else f"{k[0]}{run}.{i} ", zero + timedelta(seconds=run * 3 + i)) for i, k in enumerate(kinds)]
    return rows


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_any_cut_of_the_events_folds_alike(spark, tmp_path, parts):
    """Micro-batches hold the events in any order, and some of them twice."""
    rows = run_events()
    rng = np.random.default_rng(parts)
    order = rng.permutation(len(rows))
    for i in range(parts):
        part = [rows[j] for j in order[i::parts]] + [rows[j] for j in order[: 5 * i]]
        if i == 0:
            part += [(None, 1, "token", "x", rows[0][4]), (3, None, "token", "x", rows[0][4])]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    fold_to(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    found = folded(spark, f"{tmp_path}/out").collect()
    want = scorecard.fold_events(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["run_id"], r["answer"], r["model"], r["n"]) for r in found) == sorted((r["run_id"], r["answer"], r["model"], r["n"]) for r in want)
    assert {r["run_id"] for r in found if r["ended"]} == {0, 3, 6, 9} and not any(r["closed"] for r in found)


def test_runs_that_never_end_close(spark, tmp_path):
    """When event time has passed, an idle run closes; later events of it change nothing, and a restart goes on."""
    zero = datetime(2024, 1, 1)
    files = [[(1, 0, "token", "a", zero)], [(1, 1, "token", "b", zero + timedelta(seconds=5))], [(2, 0, "token", "z", zero + timedelta(hours=5))], [(2, 1, "token", "y", zero + timedelta(hours=6))], [(1, 2, "token", "late", zero + timedelta(hours=6)), (2, 0, "token", "z", zero)]]

    def feed(some):
        for rows in some:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        fold_to(stream, f"{tmp_path}/out", f"{tmp_path}/state", idle_ms=60_000, late="1 minute").awaitTermination()
        return {r["run_id"]: (r["answer"], r["closed"]) for r in folded(spark, f"{tmp_path}/out").collect()}

    assert feed(files[:2]) == {1: ("ab", False)}
    assert feed(files[2:4])[1] == ("ab", True)
    assert feed(files[4:]) == {1: ("ab", True), 2: ("zy", False)}
    copies = spark.read.parquet(f"{tmp_path}/out").groupBy("run_id", "version").agg(F.count("*").alias("c")).where("c > 1").count()
    assert not copies
    shutil.rmtree(f"{tmp_path}/in")


def test_a_run_s_events_lie_in_few_entries(monkeypatch):
    """State is written for ENTRY events at once, not for each; events that come again are told from its entries."""
    from types import SimpleNamespace

    import pandas as pd

    from tesserae.streaming import runs

    entries, told = {}, {}
    store = SimpleNamespace(iterator=lambda: iter(entries.items()), updateValue=lambda k, v: entries.__setitem__(k, v))
    value = SimpleNamespace(get=lambda: told.get(0), update=lambda v: told.__setitem__(0, v))
    handle = SimpleNamespace(getMapState=lambda *a: store, getValueState=lambda *a: value, listTimers=list, registerTimer=lambda t: None)
    folding = runs.RunFold(1000)
    folding.init(handle)
    frame = pd.DataFrame({"seq": range(2500), "type": "token", "text": [None if i == 7 else f"{i}." for i in range(2500)], "at": range(2500)})
    (first,) = folding.handleInputRows((1,), iter([frame[:1200], frame[1200:]]), None)
    assert len(entries) == 3 and first["n"][0] == 2500 and first["answer"][0] == "".join(f"{i}." for i in range(2500) if i != 7)
    assert not list(folding.handleInputRows((1,), iter([frame[:50]]), None)) and len(entries) == 3
    (again,) = folding.handleInputRows((1,), iter([frame[-1:].assign(seq=2500)]), None)
    assert len(entries) == 4 and again["n"][0] == 2501 and again["version"][0] == 2
