"""The dealt operators and the pipeline's stages against brute-force versions and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tesserae.llm import chat_format, fingerprints, packing, queries, suffix_dedup, toxicity
from tesserae.llm.common import Words
from tesserae.llm.embedding_dedup import near_duplicates
from tesserae.llm.mixing import mix_sources
from tesserae.llm.ngram_join import ngram_components
from tesserae.llm.quality import quality_scores
from tesserae.llm.suffix_dedup import merged_passages, remove_repeats
from tesserae.llm.url_filter import filter_urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


@pytest.fixture(scope="module")
def docs(spark):
    """Near and exact copies, a shared passage, nulls, blanks, a long text, repeated rows and ids."""
    base, passage = prose(0, 120), prose(1, 60)
    texts = [base, base, base.replace("w", "W", 1), base + " more", prose(2, 40) + " " + passage + " " + prose(3, 30), passage + " tail", None, "", "  \n ", "one two", "one two", prose(4, 9000)]
    texts += [base.split(" ", k + 1)[-1] for k in range(5)] + ["l " * 300, "l " * 300]
    rows = [(i, t, "en", "s0" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], (None, "no id", "en", "s1", 5), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumn("n", F.lit(1)).withColumn("copies", F.lit("x")).cache()


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80)])
def test_ngram_join(docs, n, num):
    rows = docs.select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)] if w else [])
    ids = [i for i in sets if i is not None]
    want = components(ids, [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])])
    got = ngram_components(docs, n, num, 100).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"])
        if r["doc_id"] is not None:
            assert r["n_shingles"] == len(sets[r["doc_id"]])


def test_repeats(docs):
    first, want = {}, defaultdict(set)
    rows = {r["doc_id"]: r["text"] for r in docs.where("doc_id is not null").collect()}
    for doc in sorted(rows):
        w = (rows[doc] or "").split()
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), doc) != doc:
                want[doc].update(range(i, i + 50))
    got = {r["doc_id"]: {i for s in r["spans"] for i in range(s["lo"], s["hi"])} for r in merged_passages(docs).collect()}
    assert got == want
    kept = remove_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    for r in kept.where("doc_id is not null").collect():
        assert (r["text"] or "").split() == [w for i, w in enumerate((rows[r["doc_id"]] or "").split()) if i not in want.get(r["doc_id"], ())]


def later_windows(rows):
    """Words of each document in windows of 50 that an earlier document holds, by brute force."""
    first, want = {}, defaultdict(set)
    for doc, text in sorted(rows):
        w = text.split()
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), doc) != doc:
                want[doc].update(range(i, i + 50))
    return want


def covered_words(found):
    return {r["doc_id"]: {i for s in r["spans"] for i in range(s["lo"], s["hi"])} for r in found.collect()}


def split_overlaps():
    """Pairs that share 50 words amid documents that share more with either of them on one side, but less in all."""
    texts = []
    for k in range(12):
        p = prose(100 + k, 50).split()
        left, right = prose(200 + k, 60).split(), prose(300 + k, 60).split()
        a, b = [*left, *p, *right], [*prose(400 + k, 60).split(), *p, *prose(500 + k, 60).split()]
        texts += [a, b]
        g = int(np.argmin(Words([" ".join(p).encode()]).grams(16)))  # where the suffix that A and B both retain starts
        for j in range(8):
            other = prose(1000 + 20 * k + j, 60).split()
            texts += [[*other, *p[g:], *right[: max(0, g - 10)], *other[::-1]], [*other, *left[-5:], *p[: g + 16], *other[::-1]]]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_repeats_split_over_both_sides(spark):
    rows = split_overlaps()
    want = later_windows(rows)
    assert len(want) >= 12
    assert covered_words(merged_passages(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_repeats_of_frequent_grams(spark, monkeypatch):
    """A passage that all share, and longer ones that fewer share: whatever the split, the same windows are found."""
    rng, rows = np.random.default_rng(5), split_overlaps()
    base, tails = prose(6, 60).split(), [prose(700 + k, 40).split() for k in range(6)]
    for i in range(len(rows), len(rows) + 60):
        rows.append((i, " ".join([*prose(800 + i, 30).split(), *base[rng.integers(0, 20) :], *tails[rng.integers(6)], *prose(900 + i, 30).split()])))
    want, df = later_windows(rows), spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for size in (4096, 8, 1):
        monkeypatch.setattr(suffix_dedup, "SALT_ROWS", size)
        assert covered_words(merged_passages(df)) == want


def test_packing(docs):
    encoder = packing.Encoder(**queries.BYTE_BPE)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    pieces = packing.pack(docs, queries.BYTE_BPE, with_ids=True).collect()
    sequences = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(encoder.whole(texts[p["doc_id"]] or "") + np.array([1], "<u4").tobytes(), "<u4") if p["doc_id"] is not None else np.array(p["ids"], "<u4")
        part = ids[p["start"] : p["start"] + p["length"]] if p["doc_id"] is not None else ids
        assert p["ids"] == part.tolist() and zlib.crc32(part.astype("<u4").tobytes()) == p["ids_crc32"]
        sequences[p["sequence_id"]].append(p)
    covered = Counter()
    for s in sequences.values():
        s.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in s] == np.concatenate([[0], np.cumsum([p["length"] for p in s])[:-1]]).tolist()
        total = sum(p["length"] for p in s)
        assert total <= 2048 and total & (total - 1) == 0 and len(s) <= 256
        for p in s:
            covered[p["doc_id"]] += p["length"]
    assert covered[4] == 2 * next(p["doc_tokens"] for p in pieces if p["doc_id"] == 4)  # the row is there twice


@pytest.mark.parametrize(("limits", "pool"), [((64, 4, 40), 256), ((64, 4, 40), 5), ((32, 1, 32), 8), ((64, 64, 1), 16)])
def test_packing_limits(limits, pool):
    rng = np.random.default_rng(0)
    packer, done, docs = packing.Packer(*limits, pool=pool), [], {}
    for k in range(300):
        n = int(rng.integers(1, 150))
        docs[k] = np.arange(n, dtype="<u4").tobytes(), int(rng.integers(0, n + 1))
        done += packer.add(k, *docs[k])
    done += packer.finish()
    got = defaultdict(list)
    for s in done:
        size = sum(len(p[2]) // 4 for p in s)
        assert 0 < size <= limits[0] and len(s) <= limits[1]
        assert sum(max(0, p[1] + len(p[2]) // 4 - max(p[1], docs[p[0]][1])) for p in s) <= limits[2]
        assert size & (size - 1) == 0
        for row, start, ids in s:
            got[row].append((start, ids))
    for k, (ids, _) in docs.items():
        assert b"".join(x for _, x in sorted(got[k])) == ids and [a for a, _ in sorted(got[k])] == np.cumsum([0] + [len(x) // 4 for _, x in sorted(got[k])])[:-1].tolist()


def test_packing_by_three_limits_is_full(spark):
    """With the query's limits nearly all tokens are in whole sequences although the limit on loss binds."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 3000").coalesce(1)
    found = packing.pack(docs, queries.BYTE_BPE, **queries.PACKING)
    rows = found.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sum("loss_tokens").alias("loss"), F.count("*").alias("pieces")).collect()
    assert max(r["loss"] for r in rows) == queries.PACKING["loss"] and max(r["pieces"] for r in rows) <= queries.PACKING["segments"]
    full = sum(r["n"] == 2048 for r in rows)
    assert full * 2048 / sum(r["n"] for r in rows) > 0.7
    assert sum(r["n"] == 2048 and r["loss"] == 2016 for r in rows) > 0.3 * full


def test_encoder_is_the_tokenizer():
    encoder = packing.Encoder(**queries.BYTE_BPE)
    for text in ("a  b", "a\n b \nc", "it's  <|endoftext|> x", " lead", "trail ", "é è\t\tq", "", "don't a1 b2's\r\n\r\n  z", prose(3, 200)):
        assert encoder.encode(text) == encoder.whole(text) if text else True


def test_url_rules(spark):
    urls = ["http://A.Example.org/es/1?x", "https://example.org/en/17", "http://x.com/fr/1", "http://com/de/", "ftp://q.net/a", "no scheme", None, "http://org", "://org/#y", "http://notorg/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = {r["page_id"]: r for r in filter_urls(df, queries.URL_RULES).collect()}
    assert [got[i]["rule"] for i in range(10)] == ["example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None, None, None, "org/", None]
    assert (got[0]["host"], got[0]["path"]) == ("a.example.org", "/es/1") and (got[6]["host"], got[6]["path"]) == ("", "")
    assert all(r["verdict"] in ("allow", "block") for r in got.values())


def test_url_model(spark):
    """Scores against the same smoothed models computed here."""
    rows = [(i, f"http://s{i % 7}.{'example.org/es/' if i % 3 else 'b.org/k/'}{i}") for i in range(60)] + [(100, "http://z.net/es/1"), (101, "http://z.net/k/1")]
    rows += [(102, None), (103, "http://z.net/" + "caf\u00e9/\U0001f600" * 300), (104, rows[0][1]), (104, rows[0][1]), (None, "http://z.net/es/1")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("text", F.lit("clash")).withColumn("score", F.lit("clash"))
    found = filter_urls(df, queries.URL_RULES).collect()
    by_shuffle = filter_urls(df, queries.URL_RULES, broadcast_grams=0).collect()
    flat = lambda rows: sorted((r["page_id"] or -1, r["host"], r["path"], r["verdict"], round(r["score"], 9)) for r in rows)
    assert flat(found) == flat(by_shuffle) and len(found) == len(rows) and filter_urls(df.limit(0), queries.URL_RULES).count() == 0
    got = {r["page_id"]: r for r in found}
    assert got[102]["score"] == 0
    counts = {"allow": Counter(), "block": Counter()}
    for r in found:
        text = r["host"] + r["path"]
        if r["rule"] and zlib.crc32(text.encode()) % 5:
            padded = "\x01" * 4 + text
            counts[r["verdict"]].update(padded[i - k : i + 1] for i in range(4, len(padded)) for k in range(5))

    def p(kind, gram):
        out = 1 / 256
        for k in range(5):
            context = gram[4 - k : 4]
            after = {g: c for g, c in counts[kind].items() if len(g) == k + 1 and g[:-1] == context}
            if after:
                out = (after.get(gram[4 - k :], 0) + len(after) * out) / (sum(after.values()) + len(after))
        return out

    for page in (0, 1, 100, 101, 103):
        text = "\x01" * 4 + got[page]["host"] + got[page]["path"]
        want = np.mean([np.log(p("allow", text[i - 4 : i + 1]) / p("block", text[i - 4 : i + 1])) for i in range(4, len(text))])
        assert got[page]["score"] == pytest.approx(want, abs=1e-9)


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x[100:200] = x[0] + rng.normal(size=(100, 16)) * rng.uniform(0.02, 0.12, (100, 1))
    x[200:220] = x[1]
    rows = [(i, [float(v) for v in x[i]], i % 2 if i % 5 else 0) for i in range(300)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [1.0], 1), (304, [1.0] * 16, None), (305, [], 0), (306, [2 * float(v) for v in x[1]], 0)]
    good = {i: (np.array(v) / np.linalg.norm(v), k) for i, v, k in rows if v and k is not None and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= 0.98]
    n, want = Counter(i for pair in links for i in pair), components([r[0] for r in rows], links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit(0))
    named = df.withColumn("label", F.concat(F.lit("l"), "label"))
    for given, options in ((df, {}), (named, {"block": 16, "pivots": 5}), (df, {"block": 7, "pivots": 30}), (df, {"block": 16, "pivots": 1})):
        got = near_duplicates(given, **options).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (n[i], want[i], want[i] == i) for i, _, _ in rows}
    again = near_duplicates(df.union(df.where("vec_id in (3, 300)"))).where("vec_id in (3, 300)").collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in again) == [(3, n[3] + 1, want[3])] * 2 + [(300, 0, 300)] * 2
    assert near_duplicates(df.limit(0)).count() == 0


def test_embeddings_meet_in_cells(spark, monkeypatch):
    """The query's labels have several cells each, vectors are replicated between them, and the links are the plain ones."""
    from tesserae.llm import embedding_dedup

    sets, placed = [], []
    pivots, write = embedding_dedup._pivots, embedding_dedup.cut
    monkeypatch.setattr(embedding_dedup, "_pivots", lambda *a: sets.append(pivots(*a)) or sets[-1])

    def counted(df):
        out = write(df)
        placed.append(("cell" in out.columns, out.count()))
        return out

    monkeypatch.setattr(embedding_dedup, "cut", counted)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.op1_embedding_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert len(sets[0]) >= 8 and all(len(p) >= 2 for p in sets[0].values())
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    x = {r["vec_id"]: np.array(r["embedding"], float) / np.linalg.norm(np.array(r["embedding"], float)) for r in rows}
    label = {r["vec_id"]: r["label"] for r in rows}
    ids = sorted(x)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if label[a] == label[b] is not None and x[a] @ x[b] >= 0.98]
    degree, component = Counter(v for pair in links for v in pair), components(ids, links)
    assert got == {i: (degree[i], component[i]) for i in ids}
    assert next(n for cells, n in placed if cells) > 1.2 * placed[1][1]


def followers(rows):
    """(row, the next row in descending doc_id) with those that repeat an id by text and those without one last."""
    order = sorted(rows, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["text"] or ""))
    return list(zip(order, order[1:] + order[:1], strict=True))


def test_fingerprints(docs):
    """Every row, those without an id and with a repeated one too; both columns follow from the returned strings."""
    got = Counter(tuple(r) for r in fingerprints.fingerprints(docs).collect())
    want, prints = Counter(), {}
    for r, after in followers(docs.collect()):
        text, other = r["text"] or "", after["text"] or ""
        edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        a, e, n = (prints.setdefault(t, fingerprints.Prints.of([t]).written()[0]) for t in (text, edited, other))
        assert (a == e) == (text == edited) and (a == n) == (text == other)
        near = fingerprints.likeness(a, e), fingerprints.likeness(a, n)
        assert all(0 <= x <= 1 for x in near) and (near[0] == 1) == (text == edited) and (near[1] == 1) == (text == other)
        want[r["doc_id"], len(text), hashlib.sha256(edited.encode()).hexdigest(), a, e, *near] += 1
    assert got == want


def plain_likeness(a, b):
    """What doubling lengths around common anchors, starts and ends show to be common, by plain comparison."""
    if a == b:
        return 1.0
    depth = lambda t: next(k for k in range(99) if 8 << k >= len(t)) + 1

    def anchors(t):
        h, out = fingerprints.PrefixHashes(t).windows(20), {}
        for i in np.flatnonzero(fingerprints.mix(h, 9) % np.uint64(16) == 0):
            out.setdefault(int(fingerprints.mix(h[i : i + 1], 5)[0] >> np.uint64(32)), int(i))
        return dict(sorted(out.items())[: fingerprints.KEPT])

    def reach(x, y):
        out = 0
        for k in range(min(depth(a), depth(b))):
            if x[: 8 << k] == y[: 8 << k]:
                out = min(8 << k, len(x), len(y))
        return out

    mine, other = anchors(a), anchors(b)
    cover = set(), set()
    for i, j, least in [(mine[v], other[v], 20) for v in mine.keys() & other.keys()] + [(0, 0, 0), (len(a), len(b), 0)]:
        left, right = reach(a[:i][::-1], b[:j][::-1]), max(least, reach(a[i:], b[j:]))
        for c, at in zip(cover, (i, j), strict=True):
            c.update(range(at - left, at + right))
    return min(1 - 1 / 1024, (len(cover[0]) + len(cover[1])) / (len(a) + len(b)))


def test_likeness_by_extensions(spark):
    """near_next and near_edited against plain character comparison; in one task's chunk and split over many."""
    rng, texts = np.random.default_rng(8), []
    for i in range(60):
        base = texts[-1] if texts and rng.random() < 0.6 else prose(5000 + i, int(rng.integers(1, 400)))
        at, to = np.sort(rng.integers(0, len(base) + 1, 2)).tolist()
        texts.append([base, base[:at] + prose(6000 + i, 5) + base[to:], base[to:] + " " + base[:at], base[at:], "\u00e9\U0001f600" + base][int(rng.integers(5))])
    texts += ["", "", "a", "ab", "x" * 50, "x" * 50, "x" * 49, "x" * 8, "x" * 64]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for options in ({}, {"chunk": 300}, {"buckets": 1}):
        got = {r["doc_id"]: r for r in fingerprints.fingerprints(df, **options).collect()}
        for i, text in enumerate(texts):
            other = texts[i - 1]
            edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
            assert got[i]["near_next"] == pytest.approx(plain_likeness(text, other))
            assert got[i]["near_edited"] == pytest.approx(plain_likeness(text, edited))
            assert fingerprints.likeness(got[i]["fingerprint"], got[i]["edited_fingerprint"]) == got[i]["near_edited"]


def test_likeness_tells_copies_from_others(spark):
    base = prose(1, 2000).split()
    near = " ".join(base[:700] + ["new", "words"] + base[703:1500] + base[1520:])
    a, b, c = fingerprints.Prints.of([" ".join(base), near, prose(2, 2000)]).written()
    assert fingerprints.likeness(a, b) > 0.5 and fingerprints.likeness(a, c) < 0.05 and fingerprints.likeness(a, b) == fingerprints.likeness(b, a)


def test_prefix_hashes():
    a, b = fingerprints.PrefixHashes("xxabcdef"), fingerprints.PrefixHashes("abcdeg")
    assert a.equal(2, 7, b, 0) and not a.equal(2, 8, b, 0)
    assert a.extension(2, b, 0) == 5
    assert fingerprints.join_hashes(int(a.spans(2, 4)), 2, int(a.spans(4, 7))) == int(b.spans(0, 5))


CHAT_LIMITS = [{}, {"segment_turns": 3, "sequence_chars": 300}, {"segment_chars": 60}]


@pytest.mark.parametrize("limits", CHAT_LIMITS)
@pytest.mark.parametrize("encoder", [None, queries.BYTE_BPE])
def test_chat(spark, encoder, limits):
    rows = [(c, t, "assistant" if t % 2 else "user", f"t{t}" if t < c % 4 else f"c{c}t{t}\\n <|im_end|>") for c in range(12) for t in range(5)]
    rows += [(50, t, "user", f"long {t}") for t in range(300)] + [(51, t, "user" if t < 270 else "assistant", f"long {t}") for t in range(280)]
    rows += [(60, 0, None, None), (60, 0, "as\nsistant", "x\\|<|"), (60, None, "system", ""), (61, 0, "user", "a"), (61, 0, "user", "a"), (None, 0, "user", "q")]
    rows += [(70, 0, "user", queries.CONTROL), (70, 1, "assistant", queries.CONTROL + "<|endoftext|> \u00e9\U0001f600"), (71, 0, "assistant", "  two  spaces \n\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1)).withColumn("ids", F.lit(1))
    sequences = chat_format.format_conversations(df, encoder, **limits).collect()
    for s in sequences:
        assert (s["ids"] is None) == (encoder is None) == (s["text"] is not None)
        for node, up in zip(s["nodes"], s["ancestors"], strict=True):
            root = node
            while root["parent"] >= 0:
                root = s["nodes"][root["parent"]]
            assert node["position"] == root["position"] + sum(i["end"] - i["start"] for i in up)
    size = lambda s: len(s["text"] if encoder is None else chat_format.Reader(encoder).text(s["ids"]))
    if not limits:
        assert sum(map(size, sequences)) < sum(len(chat_format.render(r[2] or "", r[3] or "")[0]) for r in rows)
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(df, encoder, **limits), encoder).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")
    assert len(got) == len({r[0] for r in rows})
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for r, t in turns if r == "assistant")
        g = got[conv]
        assert g["n_turns"] == len(turns) and g["loss_chars"] == len(loss)
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert g["formatted_chars"] == sum(len(chat_format.render(r, t)[0]) for r, t in turns)
    empty = chat_format.format_conversations(df.limit(0), encoder, **limits)
    assert chat_format.read_back(empty, encoder).count() == 0


@pytest.mark.parametrize("encoder", [None, queries.BYTE_BPE])
def test_chat_attends_over_segments(spark, encoder):
    """What a conversation's last turn attends to, with itself, is the whole conversation, however many segments."""
    lengths = {1: 700, 2: 660, 3: 256, 4: 257, 5: 5, None: 300}
    rows = [(c, t, "user", f"turn {t}" if t < 600 or c == 1 else f"other {t}") for c, n in lengths.items() for t in range(n)]
    got = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), encoder).collect()
    texts, ends, read = {s["sequence"]: s["ids"] or s["text"] for s in got}, {}, chat_format.Reader(encoder).text
    for s in got:
        before = {x["top"]: x["before"] for x in s["before"]}
        for leaf in (x for x in s["leaves"] if x["last"]):
            top, node = leaf["node"], s["nodes"][leaf["node"]]
            while s["nodes"][top]["parent"] >= 0:
                top = s["nodes"][top]["parent"]
            seen = [texts[i["sequence"]][i["start"] : i["end"]] for i in before.get(top, ())]
            seen += [texts[s["sequence"]][i["start"] : i["end"]] for i in s["ancestors"][leaf["node"]]]
            assert sum(map(len, seen)) == node["position"]
            ends[leaf["conv_id"]] = "".join(map(read, [*seen, texts[s["sequence"]][node["start"] : node["end"]]]))
    assert ends == {c: "".join(chat_format.render(r[2], r[3])[0] for r in rows if r[0] == c) for c in lengths}


def test_mixing(docs, spark):
    got = mix_sources(docs, exponent=0.5)
    assert {*got.columns} == {*docs.columns, "copy"}
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    share = {r["source"]: r["count"] for r in mix_sources(many, {"a": 3.0, "b": 1.0}).groupBy("source").count().collect()}
    assert share["a"] / sum(share.values()) == pytest.approx(0.75, abs=0.02) and sum(share.values()) == pytest.approx(20000, rel=0.03)


def test_learned_scores(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(19)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for fn, mod, fold in ((quality_scores, 5, 0), (toxicity.toxicity_scores, 3, 1)):
        for rows in (docs, docs.limit(0)):
            for known in (labels, labels.limit(0)):
                got = fn(rows, known).collect()
                assert len(got) == rows.count()
                for r in got:
                    assert 0 <= r["score"] <= 1
                    assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % mod == fold)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_quality_classifier(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.9


def test_gradient():
    rng = np.random.default_rng(0)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    inputs = toxicity.Inputs([b"you are bad", b"so it is good " * 9])
    y = np.array([1, 0, 0])[inputs.text[:3]].astype(float)
    ids = inputs.ids[: len(y)]
    g = net.gradient((inputs.row, inputs.chars), ids, y)

    def loss():
        x, _ = net.embed(inputs.row, inputs.chars)
        p = toxicity._sigmoid(net.run(x, ids))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name in ("whf", "wxb", "attend", "value", "wbf"):
        v = net.p[name]
        at = tuple(rng.integers(0, s) for s in v.shape)
        old = v[at]
        v[at] = old + 1e-2
        up = loss()
        v[at] = old - 1e-2
        down = loss()
        v[at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(g[name][at]), rel=0.05, abs=2e-4)


def test_toxicity_reads_whole_words():
    rng = np.random.default_rng(3)
    plain = ["river", "garden", "window", "market", "summer", "letter", "bridge", "kitchen", "paper", "morning"]
    text = lambda n, *more: [*(plain[i] for i in rng.integers(0, len(plain), n)), *more]
    texts = [text(12, "zzqvile") if i % 2 else text(12) for i in range(400)]
    net = toxicity.train([" ".join(x).encode() for x in texts], np.arange(400) % 2)
    for sep in (" ", "\u00a0", "\u3000", "\u2009", "_", "-", ".", "...", ""):
        for n in (3, 200):
            good, bad = toxicity.score_texts(net, [sep.join(x).encode() for x in (text(n), text(n, "zzqvile"))])
            assert good < 0.5 < bad, (sep, n)
    steps = toxicity.Inputs([b"a" * 11, b"abcdefghijklmnopqrstuvwxyz", b"", b"-" * 30, b"x y"])
    assert steps.n_words.tolist() == [1, 3, 0, 3, 2]


@pytest.mark.parametrize("name", ["op3_suffix_array_dedup", "op7_source_mixing", "op9_ngram_jaccard_join"])
def test_empty_tables(spark, docs, name):
    empty = docs.select(*DOCS.replace(" long", "").replace(" string", "").split(", ")).limit(0)
    fn = {"op3": merged_passages, "op7": mix_sources, "op9": ngram_components}[name[:3]]
    assert fn(empty).count() == 0


def test_pipeline_keeps_unlike_texts_of_one_id(spark):
    import corpus_pipeline

    a, b, c = prose(50, 40), prose(51, 40), prose(52, 40)
    rows = [(1, a, "en", "s1", 5), (1, a, "en", "s0", 5), (1, b, "en", "s0", 5), (2, c, "en", "s0", 5), (None, c, "en", "s0", 5), (3, None, None, None, None), (3, None, None, None, None)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "")
    assert Counter(map(tuple, kept.collect())) == Counter(rows[1:6])


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, sf))
        assert docs.count() > 0
        assert name == "packing" or docs.columns == columns
    assert sorted(map(tuple, docs.select("doc_id", "ids_crc32").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "ids_crc32").collect()))


def brute_components(rows, n, num, den=100):
    """component of each doc_id by comparing all pairs of whole sets."""
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)] if w else [])
    return components([*sets], [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])])


@pytest.mark.parametrize(("large", "block"), [(64, 1024), (0, 5)])
def test_ngram_join_of_large_buckets(spark, large, block):
    """Chains of copies whose ends are unlike, and many documents that share a passage but are unlike: any plan, one result."""
    rng, rows = np.random.default_rng(9), []
    for group in range(4):
        now = prose(60 + group, 80).split()
        for _ in range(40):
            rows.append((len(rows), " ".join(now)))
            at = int(rng.integers(0, len(now) - 1))
            now = [*now[:at], f"x{rng.integers(0, 9999)}", *now[at + 1 :]] if rng.random() < 0.7 else [*now, f"y{rng.integers(0, 9999)}"]
    shared = prose(80, 40)
    rows += [(len(rows) + i, f"{shared} {prose(2000 + i, int(rng.integers(1, 12)))}") for i in range(60)]
    rows += [(len(rows) + i, prose(3000 + i, 700 + i)) for i in range(4)] + [(900, prose(3000, 700) + " z"), (901, None), (902, "")]
    found = ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 85, 100, large=large, block=block).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(rows, 4, 85)


def test_columns_may_have_any_name(spark):
    names = ["_id", "_key", "spans", "_cdf", "_order", "_times", "_n", "_w", "_salt", "key", "doc", "cuts", "cdf", "order", "times", "Salt", "_gone", "rest", "n", "w", "copy"]
    passage = prose(5, 60)
    rows = [(i, f"{prose(10 + i, 20)} {passage}" if i < 3 else None, f"s{i % 2}", 5) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    df = df.select("*", *(F.lit(f"v {c}").alias(c) for c in names))
    kept = remove_repeats(df)
    assert kept.columns == df.columns and {r["order"] for r in kept.collect()} == {"v order"}
    assert {r["doc_id"]: len((r["text"] or "").split()) for r in kept.collect()} == {0: 80, 1: 20, 2: 20, 3: 0, 4: 0, 5: 0}
    for sources in (10, 1):
        got = mix_sources(df, sources=sources)
        assert sorted(got.columns) == sorted(df.columns)
        assert {r["_order"] for r in got.collect()} == {"v _order"}


def test_mixing_by_salted_rates(spark):
    """The join of salted rates gives the rows that broadcast rates give."""
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "a").when(F.col("id") % 2 == 0, "b").alias("source"), F.lit("t").alias("text"))
    rows = [Counter(map(tuple, mix_sources(many, sources=n).collect())) for n in (10_000, 0)]
    assert rows[0] == rows[1] and sum(rows[0].values()) > 2000
