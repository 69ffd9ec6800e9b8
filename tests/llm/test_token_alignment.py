"""The alignment of two tokenizers against a plain version over token lists."""

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import queries, token_alignment
from tesserae.llm.token_alignment import align_tokens, byte_level

SOURCE = "doc_id long, text string, n_a long"


@pytest.fixture(scope="module")
def plain():
    """(A tokens, B tokens) of a text as lists of (id, bytes)."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table = byte_level(a.get_vocab())

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def both(text):
        if not text:
            return [], []
        left = [(i, table[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes_b(i)) for i in b.encode(text)]
        raw = (" " + text).encode()
        return (left, right) if b"".join(t for _, t in left) == raw == b"".join(t for _, t in right) else ([], [])

    return both


def ends_of(tokens):
    out = []
    for _, t in tokens:
        out.append((out[-1] if out else 0) + len(t))
    return out


def expected(rows, both):
    found, holders = [], Counter()
    for doc_id, text in rows:
        left, right = both(text)
        ends_a, ends_b = ends_of(left), ends_of(right)
        cuts = sorted({*ends_a} & {*ends_b})
        groups = [([], []) for _ in cuts]
        for tokens, ends, side in ((left, ends_a, 0), (right, ends_b, 1)):
            for (i, _), e in zip(tokens, ends):
                groups[bisect_left(cuts, e)][side].append(i)
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        holders.update(links.keys())
        found.append((doc_id, left, right, groups, links))
    best = defaultdict(int)
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, left, right, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(left), len(right), len(groups), links.total(), sum(n for p, n in links.items() if holders[p] == best[p[0]]), sum(n * holders[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if left else ""))
    return out


def compare(df, both, **kw):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    found = align_tokens(df, queries.ALIGNED, **kw)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, expected(rows, both)))


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " ", "one", "one", "One two  three", " lead", "trail ", "a▁b", "a ▁ b", "x<|endoftext|>y <s> </s>", "x<0x41>y", "tab\tline\nend\r\n", "naïve façade ﬁ é é", "日本語の文章です。", "😀😀 👩‍👩‍👧 x", "\x00 \x7f", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "        " * 20 + "x", "ab " * 3000, "　\xa0 y"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, "one", 2), (3, "one", 1), (3, "other", 1), (None, "one", 1), (None, "one", 1), (None, "no id", 1), (None, None, None), (1, "", 5), (1, "", 5)]
    return spark.createDataFrame(rows, SOURCE).withColumns({c: F.lit("own") for c in ("same", "side", "start", "pairs", "copies")}).repartition(3).cache()


def test_odd_rows(odd, plain):
    compare(odd, plain)


def test_small_blocks_and_links(odd, plain, monkeypatch):
    """Blocks of three tokens, links summed all the time, and counts that meet links in a join."""
    monkeypatch.setattr(token_alignment, "BLOCK", 3)
    monkeypatch.setattr(token_alignment, "LINKS", 4)
    compare(odd, plain, broadcast_pairs=0)


def test_documents(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    compare(docs, plain)


def test_empty(odd):
    assert align_tokens(odd.limit(0), queries.ALIGNED).count() == 0
    assert align_tokens(odd.limit(0), queries.ALIGNED, broadcast_pairs=-1).count() == 0


def test_both_libraries_encode_alike():
    ranked = token_alignment.Sides(**queries.ALIGNED)
    plain = token_alignment.Sides(queries.ALIGNED["tokenizer_path"], queries.ALIGNED["pieces_path"])
    for text in ("a b c", "a  b", "x\n y", "x \n y", "é è", "▁", "it's don't", "1 22 333", "<|endoftext|>", "word\n\nword", ""):
        assert ranked.encode(text) == plain.encode(text)
