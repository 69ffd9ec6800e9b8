"""BM25 scored where documents are scanned: against sums in Python, with ties and repeats, and what it costs."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tesserae.operators import retrieve

QUERIES = [(1, "w1 w2 w3"), (2, "w900 W1 w1"), (3, "é w40 w41 w42 w200"), (4, " "), (5, None), (6, "nowhere"), (7, "same same words")]


def rows(n=600):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, int(rng.integers(1, 60))), 900)) for _ in range(n)]
    return [*enumerate(texts), *((n + i, "some words, the same words") for i in range(40)), (n + 50, None), (n + 51, ""), (n + 52, "É é")]


def best(docs, k):
    """(query_id, doc_id) -> rank; rows of one doc_id are one document, but each counts in the number of documents."""
    held, lengths = defaultdict(Counter), Counter()
    for i, t in docs:
        held[i].update(re.findall(r"\w+", (t or "").lower()))
    lengths = {i: sum(c.values()) for i, c in held.items()}
    average, df = sum(lengths.values()) / len(docs), Counter(t for c in held.values() for t in c)
    out = {}
    for q, text in QUERIES:
        found = []
        for i, c in held.items():
            parts = [math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * lengths[i] / average)) for t in set(re.findall(r"\w+", (text or "").lower())) if c[t]]
            found += [(-round(sum(parts), 9), i)] if parts and i is not None else []
        out |= {(q, i): rank for rank, (_, i) in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("cells", [1 << 21, 50])
def test_scores_of_a_scan(spark, monkeypatch, repeated, cells):
    docs = rows() + ([(5, "w1 w2 other"), (None, "w1 w2 w3")] if repeated else [])
    monkeypatch.setattr(retrieve, "CELLS_AT_ONCE", cells)
    monkeypatch.setattr(retrieve, "SUMS_AT_ONCE", 7)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = retrieve.bm25(spark.createDataFrame(QUERIES, "query_id long, text string"), df, 5).collect()
    assert {(r["query_id"], r["doc_id"]): r["rank"] for r in found} == best(docs, 5)


def test_pairs_are_not_shuffled(spark):
    """Rows of queries and documents met in a join and a sum before; now each task sends on what can be among the best."""
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    found = retrieve.bm25(spark.createDataFrame(QUERIES, "query_id long, text string"), docs, 5)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
