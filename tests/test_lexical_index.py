"""The persisted index against BM25 over the documents: parts, repeats, skipped blocks, streams."""

import numpy as np
from pyspark.sql import functions as F

from tesserae.operators import lexical_index, retrieve
from tesserae.operators.lexical_index import drop_part, index_stream, plan_search, search, write_part

DOCS = "doc_id long, text string"


def corpus(spark, n=1500, seed=0):
    """Words of a skewed vocabulary in documents of unlike lengths."""
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, int(rng.integers(3, 120))), 3000))) for i in range(n)]
    return spark.createDataFrame(rows + [(n, None), (n + 1, ""), (n + 2, "W1 w1, É é")], DOCS)


def same(a, b):
    key = lambda df: sorted((r["query_id"], r["doc_id"], round(r["score"], 6), r["rank"]) for r in df.collect())
    return key(a) == key(b)


def test_search_is_bm25(spark, tmp_path):
    docs, path = corpus(spark), f"{tmp_path}/index"
    queries = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w900 w1"), (3, "é w40 w41 w42 w2000"), (4, " "), (5, None), (6, "nowhere"), (7, "w5 w5 w5")], "query_id long, text string")
    assert search(spark, path, queries, 5).count() == 0
    for part in range(3):
        write_part(docs.where(F.col("doc_id") % 3 == part), path, f"p{part}", block=16)
    want = retrieve.bm25(queries, docs, 5)
    assert same(search(spark, path, queries, 5), want)
    write_part(docs.where("doc_id % 3 = 1"), path, "p1", block=16)  # a run that was repeated
    assert same(search(spark, path, queries, 5), want)
    other = spark.createDataFrame([(1, "w1 new"), (4, "w2 words")], DOCS)
    write_part(other, path, "p1", block=16)  # a source that changed
    rest = docs.where("doc_id % 3 <> 1")
    assert same(search(spark, path, queries, 5), retrieve.bm25(queries, rest.union(other), 5))
    drop_part(spark, path, "p1")
    assert same(search(spark, path, queries, 5), retrieve.bm25(queries, rest, 5))


def test_blocks_are_skipped(spark, tmp_path, monkeypatch):
    """Of the blocks that hold a query's terms less than half are read for its best five."""
    docs, path = corpus(spark, 3000, 1), f"{tmp_path}/index"
    write_part(docs, path, "all", block=16)
    queries = spark.createDataFrame([(1, "w1 w700"), (2, "w2 w350"), (3, "w3 w900 w120")], "query_id long, text string")
    read = []
    scored = lexical_index.score_blocks
    monkeypatch.setattr(lexical_index, "score_blocks", lambda p, t, blocks, *a: read.append(blocks.count()) or scored(p, t, blocks, *a))
    assert same(search(spark, path, queries, 5), retrieve.bm25(queries, docs, 5))
    _, _, bounds = plan_search(spark, path, queries)
    assert sum(read) < 0.5 * bounds.count()


def test_streamed_parts(spark, tmp_path):
    docs, path = corpus(spark, 300, 2), f"{tmp_path}/index"
    queries = spark.createDataFrame([(1, "w1 w2 w90")], "query_id long, text string")
    for k in range(2):
        docs.where(F.col("doc_id") % 2 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        index_stream(stream, path, f"{tmp_path}/state").awaitTermination()
    assert same(search(spark, path, queries, 5), retrieve.bm25(queries, docs, 5))
