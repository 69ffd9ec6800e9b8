"""Candidates are ranked by the whole query, also beyond its first 512 characters."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__

LONG = "filler " * 100 + "zebra quagga okapi"


def test_later_turns_meet_the_whole_first_turn(spark, tmp_path):
    turns = pa.table({"conv_id": [1] * 4, "turn": pa.array([0, 1, 2, 3], pa.int32()), "role": ["user"] * 4, "text": [LONG, "nothing alike", "filler other words", "zebra quagga okapi"]})
    pq.write_table(turns, tmp_path / "conversations.parquet")
    found = __spark_entry__.queries()["o04_rerank_order"](spark, str(tmp_path)).collect()
    assert sorted((r["rank"], r["doc_id"], r["score"]) for r in found) == [(1, 0, 1.0), (2, 3, 0.866025), (3, 2, 0.288675)]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()["o04_rerank_order"]).fetchall()
    assert sorted((r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in found) == sorted(want)


def test_passages_are_ranked_by_the_whole_query(spark, tmp_path):
    """Without what follows the first 512 characters, the document of filler would be first."""
    pq.write_table(pa.table({"item_id": [1], "text": [LONG]}), tmp_path / "benchmark.parquet")
    texts = ["filler other words", "zebra quagga okapi", "nothing alike"]
    pq.write_table(pa.table({"doc_id": [1, 2, 3], "text": texts}), tmp_path / "documents.parquet")
    found = __spark_entry__.queries()["m11_rerank"](spark, str(tmp_path)).collect()
    assert sorted((r["rank"], r["doc_id"], r["score"]) for r in found) == [(1, 2, 0.866025), (2, 1, 0.288675)]
