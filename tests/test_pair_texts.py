"""Texts of pairs that were found, brought to them without moving all texts."""

from pyspark.sql import functions as F

from tesserae.operators import retrieve

ROWS = [(i, f"text {i}") for i in range(50)]


def test_texts_of_pairs_are_not_shuffled(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    pairs = docs.where("doc_id < 4").select(F.lit(1).alias("query_id"), "doc_id")
    whole = retrieve.with_texts(pairs, docs)
    assert "Exchange hashpartitioning" not in whole._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, whole.select("doc_id", "text").collect())) == ROWS[:4]
    assert sorted(map(tuple, retrieve.with_texts(pairs, docs, 2).select("doc_id", "text").collect())) == ROWS[:4]
