"""Each stage of the pipeline against a brute-force version over what the stage before it kept."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tesserae.llm import packing, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The rows of documents, and what each stage makes of those of the one before."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, SF))
        out.append(docs.collect())
    return out


def test_quality(spark, kept):
    scores = quality.quality_scores(spark.createDataFrame(kept[0]), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    good = {r["doc_id"] for r in scores if r["score"] >= 0.3}
    assert {r["doc_id"] for r in kept[1]} == good and 0 < len(good) < len(kept[0])


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)] if w else [])


def test_near_duplicates(kept):
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in kept[1]}
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                one, two = sorted((label[a], label[b]))
                label = {i: one if c == two else c for i, c in label.items()}
    assert {r["doc_id"] for r in kept[2]} == {i for i, c in label.items() if i == c}


def test_repeats(kept):
    first, gone = {}, defaultdict(set)
    for r in sorted(kept[2], key=lambda r: r["doc_id"]):
        w = r["text"].split()
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), r["doc_id"]) != r["doc_id"]:
                gone[r["doc_id"]].update(range(i, i + 50))
    got = {r["doc_id"]: r for r in kept[3]}
    assert got.keys() == {r["doc_id"] for r in kept[2]}
    for r in kept[2]:
        assert got[r["doc_id"]]["text"].split() == [w for i, w in enumerate(r["text"].split()) if i not in gone[r["doc_id"]]]
        assert got[r["doc_id"]]["n_chars"] == len(got[r["doc_id"]]["text"])


def test_mixing(kept):
    sizes = Counter(r["source"] for r in kept[3])
    total, weights = len(kept[3]), sum(n**0.5 for n in sizes.values())
    import hashlib
    import math

    want = Counter()
    for r in kept[3]:
        rate = total / weights * sizes[r["source"]] ** 0.5 / sizes[r["source"]]
        text = hashlib.md5((r["text"] or "").encode()).hexdigest()
        u, k, cdf = int(hashlib.md5(f"7|{r['doc_id']}|{text}|0".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate)
        while cdf <= u:
            k += 1
            cdf += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        want[r["doc_id"]] = k
    assert Counter(r["doc_id"] for r in kept[4]) == +want


def test_packing(kept):
    encoder = packing.Encoder(**corpus_pipeline.ENCODER)
    texts = Counter((r["doc_id"], r["text"]) for r in kept[4])
    tokens = {doc: np.frombuffer(encoder.whole(text) + np.array([1], "<u4").tobytes(), "<u4") for doc, text in texts}
    covered, rooms = Counter(), defaultdict(list)
    for p in kept[5]:
        ids = tokens[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert zlib.crc32(ids.tobytes()) == p["ids_crc32"] and len(ids) == p["length"]
        covered[p["doc_id"]] += p["length"]
        rooms[p["sequence_id"]].append(p)
    assert covered == {doc: n * len(tokens[doc]) for (doc, _), n in texts.items()}
    for pieces in rooms.values():
        total, bears = sum(p["length"] for p in pieces), sum(p["loss_tokens"] for p in pieces)
        assert total <= corpus_pipeline.LIMITS["tokens"] and len(pieces) <= corpus_pipeline.LIMITS["segments"] and bears <= corpus_pipeline.LIMITS["loss"]
