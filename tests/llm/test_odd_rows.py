"""Every operator and stage on null, empty and very long texts, repeated rows, empty tables and clashing columns."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import queries
from tesserae.llm.common import SHUFFLE_CLEANUP, cut, discard, scratch
from tesserae.llm.fingerprints import fingerprints
from tesserae.llm.mixing import mix_sources
from tesserae.llm.ngram_join import ngram_components
from tesserae.llm.packing import pack
from tesserae.llm.quality import keep_good, quality_scores
from tesserae.llm.suffix_dedup import merged_passages, remove_repeats
from tesserae.llm.toxicity import toxicity_scores

CLASHING = ("id", "n", "x", "fold", "component", "spans", "score", "prefix", "rank", "bucket", "head", "start", "key", "source_id", "gone", "copies")


@pytest.fixture(scope="module")
def odd(spark):
    """18 rows: 3 nulls, 2 empty, a text of 1.5 MB and an edited copy of it, repeated rows, one doc_id with two texts."""
    rng = np.random.default_rng(2)
    long = " ".join(f"v{x}" for x in rng.integers(0, 90_000, 230_000))
    texts = [None, None, "", "", "  　", "one", "one", "a b c d e f", "A B C D E F", long, long + " end", "word " * 400, "\U0001f600" * 50, "x" * 5000]
    rows = [(i, t, "en", f"s{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, None, None, None, None), (5, "another text under this id", "en", "s1", 26)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING)).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(14)] + [(7, 1, 0), (None, 1, 1), (3, None, None), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def scored(found):
    rows = found.collect()
    assert all(r["score"] is not None and 0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    return rows


def test_rows_in_rows_out(spark, odd, labels):
    ids = Counter(r["doc_id"] for r in odd.select("doc_id").collect())
    results = [ngram_components(odd, 4, 85).collect(), scored(quality_scores(odd, labels)), scored(toxicity_scores(odd, labels)), fingerprints(odd).collect()]
    for rows in results:
        assert Counter(r["doc_id"] for r in rows) == ids
    component = {r["doc_id"]: r["component_id"] for r in results[0] if r["doc_id"] != 5}
    assert component[8] == component[7] == 7 and component[10] == component[9] == 9 and component[0] == 0 and component[2] == 2 and component[None] is None
    prints = {r["doc_id"]: r["fingerprint"] for r in results[3]}
    assert prints[0] == prints[2] == prints[3] and prints[7] != prints[8] and prints[9] != prints[10]
    pieces = pack(odd, queries.BYTE_BPE, **queries.PACKING).collect()
    assert sum(r["length"] for r in pieces if r["doc_id"] == 7) == 3 * next(r["doc_tokens"] for r in pieces if r["doc_id"] == 7)
    assert {r["doc_tokens"] for r in pieces if r["doc_id"] in (0, 1, 2, 3)} == {1}
    found = {r["doc_id"]: r for r in merged_passages(odd).collect()}
    assert set(found) == {10} and found[10]["spans"][0].asDict() == {"lo": 0, "hi": 230_000}


def test_filters_keep_columns(spark, odd, labels):
    for kept in (remove_repeats(odd), keep_good(odd, labels), corpus_pipeline.near_duplicates(spark, odd, "")):
        rows = kept.collect()
        assert kept.columns == odd.columns and {r["spans"] for r in rows} <= {"own spans"} and {r["gone"] for r in rows} <= {"own gone"}
    assert remove_repeats(odd).count() == odd.count()
    mixed = mix_sources(odd)
    assert {*mixed.columns} == {*odd.columns, "copy"} and {r["key"] for r in mixed.collect()} <= {"own key"}


def test_without_labels(odd, labels):
    none = labels.limit(0)
    assert keep_good(odd, none).count() == odd.count()
    assert {r["score"] for r in scored(quality_scores(odd, none))} == {0.5} and {round(r["score"], 6) for r in scored(toxicity_scores(odd, none))} == {0.5}


def test_empty_tables(spark, odd, labels):
    none = odd.limit(0)
    for found in (ngram_components(none), quality_scores(none, labels), toxicity_scores(none, labels), fingerprints(none), pack(none, queries.BYTE_BPE), merged_passages(none), remove_repeats(none), keep_good(none, labels), mix_sources(none)):
        assert found.count() == 0


def test_stages_on_odd_rows(spark, odd, labels, tmp_path):
    """The five stages one after the other on these rows; all but the last keep the columns of documents."""
    labels.drop("text").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = cut(stage(spark, rows, str(tmp_path)))
            assert name == "packing" or out.columns == docs.columns
            rows = out
        assert name == "packing"


def test_scratch(spark, monkeypatch):
    """Shared scratch is asked for on a cluster; the setting that cut() uses is given back."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    df = cut(spark.range(10).repartition(3))
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == before and df.count() == 10
    discard(df)
    with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST|not found"):
        df.count()

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": staticmethod(lambda *_: None)})  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch(Session())
