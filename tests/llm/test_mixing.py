"""Mixing draws rows without ids and repeated rows one by one; stages keep columns of any name and type."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm.common import cut
from tesserae.llm.mixing import mix_sources

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("repeated", [200_000, 0])
def test_rows_without_ids_draw_one_by_one(spark, repeated):
    rows = [(None, f"text {i}", "en", "a", 6) for i in range(4000)] + [(None, "same", "en", "b", 4)] * 4000 + [(7, "same", "en", "c", 4)] * 4000
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = mix_sources(docs, {"a": 1.0, "b": 1.0, "c": 1.0}, total=24_000, repeated=repeated).cache()
    for source in "abc":
        mine = got.where(F.col("source") == source)
        assert abs(mine.count() / 8000 - 1) < 0.05
        first = mine.where("copy = 1").count()  # rows drawn at all: 1 - e^-2 of them
        assert abs(first / (4000 * 0.8647) - 1) < 0.05
        times = Counter(r["copy"] for r in mine.select("copy").collect())
        assert abs(times[3] / (4000 * 0.3233) - 1) < 0.15  # at least three times


def test_mean_rate_over_null_ids(spark):
    docs = spark.createDataFrame([(None, f"t{i}", "en", "s", 2) for i in range(20_000)], DOCS)
    assert abs(mix_sources(docs).count() / 20_000 - 1) < 0.03


def test_repeated_ids_with_unlike_texts(spark):
    rows = [(1, f"text {i}", "en", "s", 6) for i in range(3000)]
    assert abs(mix_sources(spark.createDataFrame(rows, DOCS)).count() / 3000 - 1) < 0.06


def test_own_columns_pass_all_stages(spark, tmp_path):
    """A column named copy, and a map, keep each row's value from stage to stage."""
    words = [" ".join(f"w{(i * 37 + k * (i + 1)) % 4999}" for k in range(60)) for i in range(300)]
    rows = [(i if i % 10 else None, w, "en", f"s{i % 3}", len(w)) for i, w in enumerate(words)] + [(5, words[5], "en", "s2", 9)] * 2
    docs = spark.createDataFrame(rows, DOCS).withColumn("copy", F.concat(F.lit("own"), F.crc32("text"))).withColumn("m", F.create_map("copy", "n_chars")).withColumn("own", F.lit(3))
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 300, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = cut(stage(spark, rows, str(tmp_path)))
        assert rows.columns == docs.columns and rows.count(), name
        held = rows.select("copy", F.concat(F.lit("own"), F.crc32("text")).alias("want"), F.map_keys("m").alias("k"), "own").collect()
        assert all(r["copy"] == r["want"] == r["k"][0] and r["own"] == 3 for r in held), name
    assert rows.where("doc_id is null").count()
