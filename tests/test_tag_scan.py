"""Tokens and tags from one scan of the texts, against plain versions, the joined form and the SQL."""

import re
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.operators import extract, tagger
from tesserae.plans import base, registry  # noqa: F401

ODD = ["m² and ½-x", "été thé", "Ⓐ_b a‿b", "with‍th the", "-a.b/c--d.-_ ...", "", " \n\t", None, "que😀the😀 queque", "x\U0001d7d8-é/ñ, Ⅷ ٣.४ 東京-the", "🇩🇪th"]


def brute(text):
    """Tokens by the pattern in which every letter and number reads as a and every white space as a blank."""
    plain = "".join("a" if unicodedata.category(c)[0] in "LN" or c == "_" else c if c in "-./" else " " if c.isspace() and not "\x1c" <= c <= "\x1f" else "!" for c in text)
    return [(m.start(), m.end()) for m in re.finditer(r"a+(?:[-./]a+)*|[^a ]", plain)]


def brute_tags(text, words):
    """(s, e, tag) by words (ord, type, surface), as the first span that meets a token has it."""
    spans = sorted((o, t, m.start(), m.end()) for o, t, w in words for m in re.finditer(re.escape(w), text))
    out = []
    for s, e in brute(text):
        over = next((x for x in spans if s < x[3] and e > x[2]), None)
        out.append((s, e, "O" if over is None else ("B-" if s <= over[2] else "I-") + over[1]))
    return out


@pytest.fixture
def small_steps(monkeypatch):
    """A task's pieces of texts and of tokens end amid what a batch holds."""
    monkeypatch.setattr(tagger, "BYTES_AT_ONCE", 90)
    monkeypatch.setattr(tagger, "TOKENS_A_BATCH", 7)


def texts():
    rng = np.random.default_rng(3)
    signs = list("ab ab .-/_²é́ \n \x1c!😀東") + ["the", "que", " "]
    return ODD + ["".join(rng.choice(signs, int(rng.integers(0, 80)))) for _ in range(200)]


def test_pieces_of_texts_and_tokens(small_steps):
    held = texts()
    batch = pa.RecordBatch.from_pydict({"k": pa.array(range(len(held)), pa.int64()), "text": pa.array(held, pa.string())})
    out = [b for b in tagger._cut(iter([batch.slice(0, 0), batch.slice(3, 40), batch.slice(0, 3), batch.slice(43)]))]
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert max(b.num_rows for b in out) <= 7
    want = {(i, n, t[s:e], s, e) for i, t in enumerate(held) if t for n, (s, e) in enumerate(brute(t))}
    assert len(rows) == len(want) and set(rows) == want


def test_tags_in_one_scan_or_joined(spark):
    held = texts()
    words = [(0, "F", "the"), (2, "G", "th"), (1, "G", "que"), (2, "A", "e t"), (0, "F", "a-b"), (3, "Z", "²"), (0, "G", "the")]
    df = spark.createDataFrame(list(enumerate(held)), "id long, text string").repartition(3)
    known = spark.createDataFrame([*words, (0, "F", ""), (0, None, "b")], "ord int, type string, surface string")
    want = {(i, *x) for i, t in enumerate(held) if t for x in brute_tags(t, words)}
    for most in (1 << 20, 0):
        got = [(r["id"], r["s"], r["e"], r["tag"]) for r in tagger.tag_texts(df, known, "id", most_bytes=most).collect()]
        assert len(got) == len(want) and set(got) == want
    assert {r["tag"] for r in tagger.tag_texts(df, known.limit(0), "id").collect()} == {"O"}
    own = df.withColumn("entities", F.when(F.col("id") % 4 > 0, F.array(*(F.struct(F.lit(t).alias("type"), F.lit(w).alias("text")) for _, t, w in words), F.struct(F.lit(None).alias("type"), F.lit("b").alias("text")))))
    ranked = [(i, t, w) for i, (_, t, w) in enumerate(words)]
    got = [(r["id"], r["s"], r["e"], r["tag"]) for r in extract.tagged(own, "id").collect()]
    assert set(got) == {(i, *x) for i, t in enumerate(held) if t for x in brute_tags(t, ranked if i % 4 else [])} and len(got) == len(want)


def test_spans_that_nest_or_touch():
    """Written out and swept, the first span over each token is the same."""
    rng = np.random.default_rng(5)
    for length in (3, 400):
        gs = rng.integers(0, 500, 80)
        ge = gs + rng.integers(1, length, 80)
        s = np.arange(0, 900, 3)
        want = [next((k for k in range(80) if a < ge[k] and a + 2 > gs[k]), 80) for a in s]
        assert tagger._first_spans(s, s + 2, gs, ge).tolist() == want


def test_odd_texts_as_in_the_sql(spark, tmp_path):
    spark.createDataFrame([*enumerate(ODD), (None, "the que")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("m14_bio_tags", "f02_tokens", "f02_token_offsets"):
        got = base.QUERIES[name](spark, str(tmp_path))
        want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({base.ORACLES[name]})").fetchall()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr), name


def test_tokens_and_spans_are_not_shuffled(spark, sf_dir):
    """Only counts are dealt by document; before, each token and each span was, and sorted."""
    plan = base.QUERIES["m14_bio_tags"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan.replace("SortAggregate", "")
