"""The positional index, phrase and proximity matches and contamination against plain versions."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tesserae.llm.decontamination import contamination, index_words, phrase_matches, phrases_of, proximity_matches


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


PASSAGE = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron."
TEXTS = [
    None, "", " .,- ", "alpha", PASSAGE, f"before it {PASSAGE.upper()} and after", PASSAGE.replace("delta", "other"), PASSAGE + " " + PASSAGE,
    "the the the the the the the the the the the the", "the " * 9, "short ITEM", "a short item here, short  item", "ÉTÉ été ÀÉ", "x été y", "１２ 12 a1b2", "ünder_score under_score",
    "kappa iota theta eta zeta epsilon delta gamma beta alpha", " ".join(f"w{i % 97}" for i in range(20_000)), "İstanbul K kelvin",
]
ITEMS = [(1, PASSAGE), (2, "the " * 10), (3, "short item"), (4, "été"), (5, ""), (6, None), (10, "never seen words in any of the documents at all"), (7, " ".join(f"w{i % 97}" for i in range(90, 130))), (8, "alpha"), (9, PASSAGE), (9, "12 a1b2"), (None, "under score"), (11, "kelvin")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, PASSAGE), (4, PASSAGE), (4, "unlike"), (None, PASSAGE), (None, PASSAGE), (None, "short item"), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("same", "term", "pos", "phrase", "n", "n_words")}).repartition(3).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("phrase", F.lit("own"))


def expected(rows, items, size=10):
    runs = {(i, tuple(w[k : k + size])) for i, t in items for w in [words(t)] for k in range(max(1, len(w) - size + 1)) if w}
    out = []
    for doc_id, text in rows:
        w, hit, named = words(text), set(), set()
        by_first = {}
        for k, x in enumerate(w):
            by_first.setdefault(x, []).append(k)
        for i, run in runs:
            for k in by_first.get(run[0], ()):
                if tuple(w[k : k + len(run)]) == run:
                    hit |= set(range(k, k + len(run)))
                    named |= {i} - {None}
        out.append((doc_id, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(map(str, named))).encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


@pytest.mark.parametrize(("size", "limit"), [(10, 200_000), (10, 0), (3, 200_000)])
def test_contamination(docs, items, size, limit):
    found = contamination(docs, items, size, limit)
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == expected(rows, ITEMS, size)


def test_empty(docs, items):
    assert contamination(docs.limit(0), items).count() == 0
    assert {r["n_hit"] for r in contamination(docs, items.limit(0)).collect()} == {0}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_phrases_and_proximity(docs, items, limit):
    texts = {i: words(t) for i, t in enumerate(TEXTS) if i != 4}
    index = index_words(docs.where("doc_id is not null and doc_id <> 4"))
    assert sorted((r["doc_id"], r["pos"], r["term"]) for r in index.collect()) == sorted((i, k, x) for i, w in texts.items() for k, x in enumerate(w))
    phrases = phrases_of(items, 3)
    runs = {r["phrase"]: tuple(r["terms"]) for r in phrases.collect()}
    got = {(r["doc_id"], r["phrase"], r["start"]) for r in phrase_matches(index, phrases, limit).collect()}
    assert got == {(i, p, k) for i, w in texts.items() for p, run in runs.items() for k in range(len(w)) if tuple(w[k : k + len(run)]) == run}
    got = {(r["doc_id"], r["phrase"], r["start"]) for r in proximity_matches(index, phrases, 5, limit).collect()}
    assert got == {(i, p, k) for i, w in texts.items() for p, run in runs.items() for k in range(len(w)) if w[k] in run and set(run) <= {*w[k : k + 5]}}


def test_plan_stays_in_the_jvm(spark, sf_dir, capsys):
    from tesserae.llm import queries

    queries.op12_decontamination(spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)
