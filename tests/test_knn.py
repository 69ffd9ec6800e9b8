"""Exact neighbours over cells and blocks against a plain search."""

import numpy as np
import pytest

from tesserae.operators import retrieve


@pytest.mark.parametrize(("cells", "block"), [(None, 8192), (1, 40), (9, 40), (30, 1000)])
def test_same_as_a_plain_search(spark, cells, block):
    """Clusters of unlike norms, ties, zero vectors, and queries that need cells other than their own."""
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 8))
    x = np.vstack([c * rng.uniform(0.2, 3) + rng.normal(size=(40, 8)) * 0.2 for c in centers] + [rng.normal(size=(60, 8)), np.zeros((3, 8))])
    x = np.vstack([x, x[:25]])
    q = np.vstack([rng.normal(size=(30, 8)), x[:20], np.zeros((1, 8)), -x[:3]])
    docs = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [1.0]), (9003, [None] + [1.0] * 7), (9004, [float("nan")] * 8), (None, [1.0] * 8)]
    queries = [(i, v.tolist()) for i, v in enumerate(q)] + [(800, None), (801, [1.0]), (802, [1.0] * 7 + [None])]
    d = spark.createDataFrame(docs, "doc_id long, vector array<double>").repartition(5)
    a = spark.createDataFrame(queries, "query_id long, vector array<double>").repartition(3)
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in retrieve.knn(a, d, 7, cells, block).collect()}
    assert len(got) == 7 * len(q)
    for i, v in enumerate(q):
        scores = x @ v
        order = np.lexsort((np.arange(len(x)), -np.round(scores, 9)))[:7]
        assert [round(got[i, r][1], 6) for r in range(1, 8)] == [round(s, 6) for s in scores[order]]
        assert all(abs(x[got[i, r][0]] @ v - got[i, r][1]) < 1e-9 for r in range(1, 8))
    assert {got[len(q) - 4, r][0] for r in range(1, 8)} == set(range(7))  # a zero query: all alike, the least ids


def test_far_cells_are_left_out(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.vstack([c + rng.normal(size=(200, 16)) * 0.05 for c in rng.normal(size=(8, 16))])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<double>")
    met = []
    block = retrieve._best_in_block
    pairs = spark.sparkContext.accumulator(0)

    def counting(k, dim):
        run = block(k, dim)

        def counted(rows):
            side = rows.column("side").to_numpy()
            pairs.add(int((side == 0).sum() * (side == 1).sum()))
            return run(rows)

        return counted

    monkeypatch.setattr(retrieve, "_best_in_block", counting)
    met = retrieve.knn(d.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id"), d, 3, cells=8).collect()
    assert len(met) == 160 * 3 and pairs.value < 0.5 * 160 * len(x)


def test_own_places_are_those_of_a_plain_search(spark, monkeypatch):
    """Copies that tie by id, rows without usable vectors, a query whose own row is missing."""
    monkeypatch.setattr(retrieve, "OWN_CHUNK", 16)
    monkeypatch.setattr(retrieve, "OWN_QUERIES", 60)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 8))
    x[300:340] = x[20:60]
    q = x + rng.normal(size=x.shape) * 0.8
    docs = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [float("nan")] * 8)]
    queries = [(i, v.tolist()) for i, v in enumerate(q) if i % 2 == 0] + [(7000, x[0].tolist()), (9001, x[0].tolist())]
    d = spark.createDataFrame(docs, "doc_id long, vector array<double>").repartition(5)
    a = spark.createDataFrame(queries, "query_id long, vector array<double>").repartition(3)
    got = {r["query_id"]: r["rank"] for r in retrieve.own_places(a, d, 10, block=30).collect()}
    want = {i: 1 + int(sum((s > x[i] @ v + 1e-9) or (abs(s - x[i] @ v) <= 1e-9 and j < i) for j, s in enumerate(x @ v))) for i, v in enumerate(q) if i % 2 == 0}
    assert got == {i: r if r <= 10 else None for i, r in want.items()} | {7000: None, 9001: None}
    assert 30 < sum(r is not None for r in got.values()) < 200
    assert retrieve.own_places(a.limit(0), d, 10).count() == 0


def test_scores_alike_in_nine_digits_keep_their_places(spark):
    class Scorer:
        def score(self, queries, texts):
            return texts.astype(float)

    rows = [(1, "q", 10, "0.7071067811865475", 1), (1, "q", 11, "0.7071067811865476", 2), (1, "q", 12, "0.9", 3)]
    found = retrieve.rerank(spark.createDataFrame(rows, "query_id int, query string, doc_id int, text string, place int"), Scorer(), 3)
    assert [r["doc_id"] for r in found.orderBy("rank").collect()] == [12, 10, 11]
