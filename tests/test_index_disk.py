"""What an index part and a search leave on disk, and blocks that are dealt to ranges or read by several tasks."""

import os
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import lexical_index, retrieve
from tesserae.operators.lexical_index import plan_search, search, write_part
from tesserae.operators.written import shared_folder

QUERIES = [(1, "w1 w2 w3"), (2, "w900 w1"), (3, "w40 w41 w42 w2000"), (4, " "), (5, None), (6, "nowhere")]


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, int(rng.integers(0, 120))), 3000)) for _ in range(n)]


def same(a, b):
    key = lambda df: sorted((r["query_id"], r["doc_id"], round(r["score"], 6), r["rank"]) for r in df.collect())
    return key(a) == key(b)


def on_disk(spark):
    """(path, bytes) of the tables between steps and of the shuffle files."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    files = [Path(shared_folder(spark)).glob("w-*/*.parquet")]
    own = []
    while found.hasNext():
        own.append(Path(found.next().getPath()))
    files.append(p for p in own if p.name.startswith("shuffle_"))
    return {(str(p), os.path.getsize(p)) for group in files for p in group if p.exists()}


def test_little_is_left_on_disk(spark, tmp_path):
    """Neither the documents' words nor a shuffle of the postings stay beside the index."""
    path = f"{tmp_path}/index"
    docs = spark.createDataFrame(list(enumerate(texts(3000))), "doc_id long, text string").repartition(4).localCheckpoint()
    before = on_disk(spark)
    write_part(docs, path, "p")
    search(spark, path, spark.createDataFrame(QUERIES, "query_id long, text string"), 5)
    left = sum(size for _, size in on_disk(spark) - before)
    assert left < 0.5 * sum(os.path.getsize(p) for p in Path(path).glob("postings/*/*.parquet"))


@pytest.mark.parametrize("words", [50, 2000, 1 << 21])
def test_ranges_hold_whole_blocks(spark, tmp_path, monkeypatch, words):
    monkeypatch.setattr(lexical_index, "RANGE_WORDS", words)
    rows = [*enumerate(texts(200, 3)), *([(7, "w1 w1 w2")] * 40), (8, None), (9, ""), (None, "w1")]
    write_part(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), f"{tmp_path}/index", "p", block=16)
    found = spark.read.parquet(f"{tmp_path}/index/postings").collect()
    want = {at: (doc_id, len(text.split()), Counter(text.split())) for at, (_, doc_id, text) in enumerate(sorted((len((t or "").split()), d, t or "") for d, t in rows if d is not None), 1)}
    held = {}
    for r in found:
        assert all(r["block"] == (p["at"] - 1) // 16 for p in r["postings"]) and r["n"] == len(r["postings"])
        assert {b["tf"]: b["shortest"] for b in r["best"]} == {tf: min(p["len"] for p in r["postings"] if p["tf"] == tf) for tf in {p["tf"] for p in r["postings"]}}
        for p in r["postings"]:
            held.setdefault(p["at"], (p["doc_id"], p["len"], Counter()))[2][r["term"]] = p["tf"]
    assert len({(r["term"], r["block"]) for r in found}) == len(found)
    assert sorted((a, d, n) for a, (d, n, _) in held.items()) == sorted((a, d, n) for a, (d, n, c) in want.items() if c)
    assert sorted((d, n, sorted(c.items())) for d, n, c in held.values()) == sorted((d, n, sorted(c.items())) for d, n, c in want.values() if c)
    assert spark.read.parquet(f"{tmp_path}/index/docs").count() == len(rows) - 1


@pytest.mark.parametrize("limits", [{}, {"BROADCAST_BLOCKS": 3}, {"BROADCAST_TERMS": 3}, {"CELLS_AT_ONCE": 40, "SUMS_AT_ONCE": 7}])
def test_rows_of_a_block_anywhere(spark, tmp_path, monkeypatch, limits):
    """A block's rows in files and tasks of any kind give the sums of all, with broadcasts and without."""
    path, other = f"{tmp_path}/index", f"{tmp_path}/other"
    docs = spark.createDataFrame(list(enumerate(texts(1200, 5))), "doc_id long, text string")
    for part in range(2):
        write_part(docs.where(F.col("doc_id") % 2 == part), path, f"p{part}", block=16)
    spark.read.parquet(f"{path}/docs").write.partitionBy("part").parquet(f"{other}/docs")
    spark.read.parquet(f"{path}/postings").repartition(5).write.partitionBy("part").parquet(f"{other}/postings")
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    want = retrieve.bm25(queries, docs, 5).localCheckpoint()
    queries = queries.union(spark.createDataFrame([(None, "w77 w78")], queries.schema))  # asks for nobody
    for name, value in limits.items():
        monkeypatch.setattr(lexical_index, name, value)
    assert same(search(spark, path, queries, 5), want)
    assert same(search(spark, other, queries, 5), want)


def test_postings_do_not_move(spark, tmp_path):
    """Blocks are scored where they are read: no exchange holds postings."""
    path = f"{tmp_path}/index"
    write_part(spark.createDataFrame(list(enumerate(texts(500, 7))), "doc_id long, text string"), path, "p", block=16)
    postings, terms, bounds = plan_search(spark, path, spark.createDataFrame(QUERIES, "query_id long, text string"))
    plan = lexical_index.score_blocks(postings, terms, bounds, 5)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Exchange (?:hash|range)partitioning\((\w+)", plan[plan.index("MapInArrow") :])) <= {"term"}  # the vocabulary's own
