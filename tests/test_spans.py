"""Many words in texts at once, and tags from overlapping spans, against plain versions and at size."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tesserae.operators import automaton, extract, tagger


def test_words_contained_and_where(spark):
    rng = np.random.default_rng(6)
    words = [("".join(rng.choice(list("abé "), int(rng.integers(1, 5)))), f"T{i % 3}", i) for i in range(60)] + [("", "T0", 99), ("aa", "T9", 7)]
    texts = [(i, "".join(rng.choice(list("abé "), int(rng.integers(0, 60))))) for i in range(80)] + [(900, None), (901, ""), (None, "aabé")]
    df = spark.createDataFrame(texts, "id long, text string").repartition(4)
    known = spark.createDataFrame(words, "surface string, type string, ord int")
    got = {(r["id"], r["type"], r["surface"]) for r in automaton.contained(df, known, "id").collect()}
    assert got == {(i, t, w) for i, x in texts if x for w, t, _ in words if w and w in x}
    want = set()
    for i, x in texts:
        for w, t, o in words:
            at = (x or "").find(w) if w else -1
            while at >= 0:
                want.add((i, t, w, o, at, at + len(w)))
                at = x.find(w, at + len(w))
    assert {tuple(r) for r in automaton.occurrences(df, known, "id").collect()} == want
    assert automaton.contained(df, known.limit(0), "id").count() == 0


def test_many_surfaces_in_one_scan_or_joined(spark):
    known = spark.range(100_000).select(F.concat(F.lit("word"), "id", F.lit(" x")).alias("surface"), F.lit("A").alias("type"))
    texts = spark.range(50).select("id", F.concat(F.lit("see Word"), F.col("id") * 1999, F.lit(" X and word7 x, word")).alias("text"))
    plans = [sorted(map(tuple, extract.recall_memorized(texts, known, "id", most_bytes=n).collect())) for n in (1 << 30, 0)]
    assert plans[0] == plans[1] and len(plans[0]) == 100


def brute_tags(toks, spans):
    out = []
    for s, e in toks:
        over = [(o, t, gs) for o, t, gs, ge in spans if s < ge and e > gs]
        out.append("O" if not over else ("B-" if s <= min(over)[2] else "I-") + min(over)[1])
    return out


def test_overlapping_spans(spark):
    rng = np.random.default_rng(7)
    toks, spans, want = [], [], {}
    for key in range(30):
        ends = np.cumsum(rng.integers(1, 6, 40))
        mine = [(int(e - rng.integers(1, 2)), int(e)) for e in ends]
        own = [(int(rng.integers(0, 4)), f"T{rng.integers(0, 3)}", int(a), int(a + rng.integers(1, 60))) for a in rng.integers(0, 150, int(rng.integers(0, 12)))]
        toks += [(key, i, f"t{i}", s, e) for i, (s, e) in enumerate(mine)]
        spans += [(key, *x) for x in own]
        want |= {(key, i): t for i, t in enumerate(brute_tags(mine, own))}
    t = spark.createDataFrame(toks, "id long, pos int, tok string, s int, e int").repartition(5)
    g = spark.createDataFrame(spans, "id long, ord int, type string, gs int, ge int").repartition(3)
    got = tagger.bio_tags(t, g, "id").collect()
    assert {(r["id"], r["pos"]): r["tag"] for r in got} == want and len(got) == len(toks)
    assert {r["tag"] for r in tagger.bio_tags(t, g.limit(0), "id").collect()} == {"O"}


def test_sweep_is_linear_in_tokens_and_spans():
    """20,000 tokens under 10,000 spans that nest: pairs would be a hundred million."""
    n, m = 20_000, 10_000
    batch = pa.RecordBatch.from_pydict({"s": pa.array(range(0, 2 * n, 2), pa.int32()), "e": pa.array(range(1, 2 * n, 2), pa.int32())})
    spans = [(i, "T", i, 2 * n - i) for i in range(m)]
    began = time.time()
    tags = tagger._tags_of(batch, spans)
    assert time.time() - began < 5 and list(tags[:3]) == ["B-T", "I-T", "I-T"]
