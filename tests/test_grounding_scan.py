"""Grounding reads the texts once for both of its lexical lists."""

from tesserae.operators import retrieve


def test_grounding_reads_texts_once(spark, monkeypatch):
    searched = []
    bm25 = retrieve.bm25
    monkeypatch.setattr(retrieve, "bm25", lambda *a: searched.append(a[2]) or bm25(*a))
    docs = spark.createDataFrame([(1, "a b", [1.0, 0.0]), (2, "b c", [0.0, 1.0])], "doc_id long, text string, vector array<double>")
    q = spark.createDataFrame([(9, "a", "c", [1.0, 0.0], [0.0, 1.0])], "query_id long, query string, answer string, query_vector array<double>, answer_vector array<double>")
    assert sorted((r["doc_id"], r["place"]) for r in retrieve.grounding(q, docs, dense_k=1).collect()) == [(1, 1), (2, 2)]
    assert searched == [15]
