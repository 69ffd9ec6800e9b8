"""What moves where the documents of an index part are numbered."""

from tesserae.operators import lexical_index
from tesserae.operators.lexical_index import write_part


def test_words_are_not_numbered(spark, tmp_path, monkeypatch):
    """Ranges are cut by numbers of rows, so only rows of a fixed width may go through them."""
    given = []
    numbered = lexical_index.numbered
    monkeypatch.setattr(lexical_index, "numbered", lambda df, *a: given.append(df.dtypes) or numbered(df, *a))
    docs = spark.createDataFrame([(2, "a b a"), (1, "c"), (1, "c"), (3, None), (None, "d")], "doc_id long, text string")
    write_part(docs, f"{tmp_path}/index", "p", block=2)
    assert {kind for row in given for _, kind in row} <= {"bigint", "int"}
    held = spark.read.parquet(f"{tmp_path}/index/postings").selectExpr("term", "block", "inline(postings)").collect()
    assert sorted((r["term"], r["doc_id"], r["tf"], r["len"], r["at"]) for r in held) == [("a", 2, 2, 3, 4), ("b", 2, 1, 3, 4), ("c", 1, 1, 1, 2), ("c", 1, 1, 1, 3)]
    assert all(r["block"] == (r["at"] - 1) // 2 for r in held)
