"""How often the texts are scanned where grams are frequent, and how the rows of that scan grow."""

import pytest

from tesserae.llm import suffix_dedup
from tesserae.llm.suffix_dedup import repeated_passages


def holders(spark, n):
    """n documents with a passage of 80 words between words of their own."""
    passage = " ".join(f"p{i}" for i in range(80))
    return spark.createDataFrame([(i, " ".join([*(f"a{i}x{k}" for k in range(20)), passage, f"z{i}"])) for i in range(n)], "doc_id long, text string")


def split_by(spark, docs, monkeypatch, rows):
    """What repeated_passages finds if grams of more than so many suffixes are split, and the rows that it writes on the way."""
    kept = []

    def cut(df):
        kept.append(suffix_dedup_cut(df))
        return kept[-1]

    suffix_dedup_cut = suffix_dedup.cut
    with monkeypatch.context() as m:
        m.setattr(suffix_dedup, "SALT_ROWS", rows)
        m.setattr(suffix_dedup, "cut", cut)
        found = repeated_passages(docs)
    return found, kept


def test_one_scan_emits_all_suffixes(spark, monkeypatch):
    docs = holders(spark, 30)
    found, kept = split_by(spark, docs, monkeypatch, 4)
    assert "xxhash64" not in found._jdf.queryExecution().toString()  # the texts' scan is behind the table that was written
    spans = {r["doc_id"]: [(s["lo"], s["hi"]) for s in r["spans"]] for r in suffix_dedup.merged_passages(docs).collect()}
    assert spans == {i: [(20, 100)] for i in range(1, 30)}
    whole, _ = split_by(spark, docs, monkeypatch, 4096)
    pairs = lambda df: {(r["doc_id"], s["lo"] + k) for r in df.collect() for s in r["spans"] for k in range(s["hi"] - s["lo"])}
    assert pairs(found) == pairs(whole)


@pytest.mark.parametrize("n", [20, 40])
def test_rows_follow_the_holders(spark, monkeypatch, n):
    """Of each document, the suffixes retained in the passage: as many rows a document in a group of any size."""
    _, kept = split_by(spark, holders(spark, n), monkeypatch, 4)
    by = kept[-1].groupBy("doc_id").count().collect()
    assert len(by) == n and len({r["count"] for r in by}) == 1
