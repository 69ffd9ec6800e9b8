"""Token tagging: tokens with offsets, features, spans, BIO tags and their decoding."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import SPACES, shape
from tesserae.operators.automaton import AUTOMATON_BYTES, SharedWords, occurrences, small_enough


def tokens(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, tok, s, e): words joined by - . /, or single symbols; offsets are in characters from 0.

    Each text is cut where it is read, by the kinds of its characters; nothing is shuffled.
    """
    schema = df.select(F.col(key), F.lit(0).alias("pos"), F.lit("").alias("tok"), F.lit(0).alias("s"), F.lit(0).alias("e")).schema
    return df.select(key, text).mapInArrow(_cut, schema)


#: Tokens of one batch that a task gives out, and bytes of texts that are cut at once (one text at least).
TOKENS_A_BATCH = 50_000
BYTES_AT_ONCE = 1 << 20
_SYMBOL, _SPACE, _WORD, _JOINER = range(4)


@cache
def _kinds() -> np.ndarray:
    """The kind of each code point: letters, numbers and _ are of words (as in the SQL), - . / may join them, white space parts."""
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    kinds[[i for i in range(len(kinds)) if unicodedata.category(chr(i))[0] in "LN"]] = _WORD
    kinds[ord("_")] = _WORD
    kinds[[ord(c) for c in "-./"]] = _JOINER
    kinds[[ord(c) for c in SPACES if not "\x1c" <= c <= "\x1f"]] = _SPACE
    return kinds


class _Pieces:
    """Tokens of some texts, laid end to end with a line break between them: s and e are places there, base is a text's first."""

    def __init__(self, keys: pa.Array, texts: list[str]):
        self.keys, self.texts = keys, texts
        self.base = np.cumsum([0, *(len(t) + 1 for t in texts)])
        code = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
        kind = _kinds()[code]
        word, solid = np.zeros(len(code) + 2, bool), kind != _SPACE
        word[1:-1] = kind == _WORD
        word[1:-1] |= (kind == _JOINER) & word[:-2] & word[2:]
        single = solid & ~word[1:-1]
        self.s = np.flatnonzero(single | (word[1:-1] & ~word[:-2]))
        self.e = np.flatnonzero(single | (word[1:-1] & ~word[2:])) + 1
        self.counts = np.diff(np.searchsorted(self.s, self.base))
        self.solid = code[solid]  # all that is not white space is of some token
        self.ends = np.cumsum(self.e - self.s)

    def batches(self, names: list[str], *more: pa.Array) -> Iterator[pa.RecordBatch]:
        """Rows (key, pos, tok, s, e) and what is given for each token."""
        row = np.repeat(np.arange(len(self.texts)), self.counts)
        first = np.cumsum(self.counts) - self.counts
        for lo in range(0, len(self.s), TOKENS_A_BATCH):
            part = slice(lo, lo + TOKENS_A_BATCH)
            of, ends = row[part], self.ends[part]
            begin = self.ends[lo - 1] if lo else 0
            code = self.solid[begin : ends[-1]]
            size = np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), dtype=np.int32)
            offsets = np.concatenate([np.zeros(1, np.int32), size[ends - begin - 1]])
            tok = pa.StringArray.from_buffers(len(of), pa.py_buffer(offsets), pa.py_buffer(code.tobytes().decode("utf-32-le").encode()))
            pos, s, e = (pa.array(x.astype(np.int32)) for x in (np.arange(lo, lo + len(of)) - first[of], self.s[part] - self.base[of], self.e[part] - self.base[of]))
            yield pa.RecordBatch.from_arrays([self.keys.take(pa.array(of)), pos, tok, s, e, *(m.slice(lo, len(of)) for m in more)], names)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[_Pieces, pa.RecordBatch]]:
    """The texts of (key, text, ..) in pieces of BYTES_AT_ONCE, cut, with the rows they are of; null texts have none."""
    batch = batch.filter(batch.column(1).is_valid())
    held = batch.column(1).cast(pa.large_binary())
    group = np.cumsum(pc.binary_length(held).to_numpy(zero_copy_only=False)) // BYTES_AT_ONCE
    begins = np.flatnonzero(np.diff(group, prepend=-1))
    for lo, hi in pairwise([*begins, len(group)]):
        yield _Pieces(batch.column(0).slice(lo, hi - lo), [t.decode(errors="replace") for t in held.slice(lo, hi - lo).to_pylist()]), batch.slice(lo, hi - lo)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pieces, _ in _pieces(batch):
            yield from pieces.batches(["key", "pos", "tok", "s", "e"])


def is_title(c):
    """Whether a token's letters are a title's: each capital begins a run of letters, and no small letter does."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+"), 0)
    return (F.size(runs) > 0) & F.forall(runs, lambda x: x.rlike(r"^\p{Lu}\p{Ll}*$"))


def features(toks: DataFrame, key: str) -> DataFrame:
    """Lower form, shape, affixes, flags and the forms of two neighbours on each side."""
    w = Window.partitionBy(key).orderBy("pos")
    low, tok = F.lower("tok"), F.col("tok")
    near = [(F.lag if k < 0 else F.lead)(c, abs(k)).over(w).alias(f"{n}{k:+d}") for k in (-2, -1, 1, 2) for n, c in (("w", low), ("shape", shape(tok)))]
    flag = lambda p, n: p.cast("int").alias(n)
    return toks.select(
        key, "pos", "tok", low.alias("w"), shape(tok).alias("shape"),
        F.left(low, F.lit(2)).alias("pre2"), F.left(low, F.lit(3)).alias("pre3"), F.right(low, F.lit(2)).alias("suf2"), F.right(low, F.lit(3)).alias("suf3"),
        flag(is_title(tok), "title"), flag((F.length("tok") > 1) & (F.upper("tok") == tok) & (low != tok), "upper"),
        flag(tok.rlike(r"\p{Nd}"), "hasdig"), flag(tok.rlike(r"^\p{Nd}+$"), "alldig"), flag(F.contains(tok, F.lit("-")), "hashyf"),
        flag(F.contains(tok, F.lit(".")), "hasdot"), flag(~tok.rlike(r"[\p{L}\p{N}]"), "punct"), F.lit(1).alias("bias"),
        flag(F.col("pos") == 0, "BOS"), flag(F.lead("pos").over(w).isNull(), "EOS"), *near,
    )


def feature_rows(wide: DataFrame, key: str) -> DataFrame:
    """(key, pos, feature, value) of features(): texts as name=value with 1, flags by name; what is null or not at an edge is left out."""
    texts = [c for c in wide.columns if c in ("w", "shape", "pre2", "pre3", "suf2", "suf3") or c[-2:] in ("-2", "-1", "+1", "+2")]
    flags = [c for c in wide.columns if c not in (*texts, key, "pos", "tok")]
    pairs = [F.struct(F.concat(F.lit(f"{c}="), F.col(f"`{c}`")).alias("feature"), F.lit(1.0).alias("value")) for c in texts]
    pairs += [F.struct(F.when((F.col(c) == 1) | (not c.isupper()), F.lit(c)).alias("feature"), F.col(c).cast("double").alias("value")) for c in flags]
    return wide.select(key, "pos", F.explode(F.array(*pairs)).alias("f")).select(key, "pos", "f.feature", "f.value").where("feature is not null")


def find_spans(df: DataFrame, surfaces: DataFrame, key: str, text: str = "text", most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(key, type, surface, ord, gs, ge): all occurrences, not overlapping, of (type, surface) in each text.

    surfaces has a text's own entities (key, ord, type, surface), which meet it in a join, or one vocabulary (type,
    surface) for all texts. A vocabulary of up to `most_bytes` is looked for in one scan of the texts; a larger one is
    joined by each surface's first word's first character, so a text meets those only that can occur in it.
    """
    found = surfaces.where(F.length("surface") > 0)
    if "ord" not in found.columns:
        found = found.withColumn("ord", F.lit(0))
    if key in found.columns:
        pairs = found.select(key, "type", "surface", "ord")
    elif small_enough(found, most_bytes=most_bytes):
        return occurrences(df, found.select("type", "surface", "ord").distinct(), key, text)
    else:
        first = r"(?U)\w+|[^\w\s]"
        words = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(?U)\w|[^\w\s]"), 0))).alias("c"))
        pairs = words.join(found.withColumn("c", F.substring(F.regexp_extract("surface", first, 0), 1, 1)), "c").select(key, "type", "surface", "ord").distinct()
    parts = F.split(F.col(text), F.concat(F.lit("\\Q"), F.col("surface"), F.lit("\\E")))
    rows = df.select(key, text).join(pairs, key).where(F.contains(F.col(text), F.col("surface")))
    rows = rows.select(key, "type", "surface", "ord", F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("k", "gap"))
    w = Window.partitionBy(key, "type", "surface", "ord").orderBy("k")
    end = F.sum(F.length("gap") + F.length("surface")).over(w)
    return rows.select(key, "type", "surface", "ord", (end - F.length("surface")).cast("int").alias("gs"), end.cast("int").alias("ge"))


def stretches(gs: np.ndarray, ge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges, best) of spans gs:ge in order of rank: best[i] is the first one over edges[i - 1]:edges[i].

    Where none is, best is the number of spans. Few stretches a span are written out, the first span last; where spans
    nest deeper, their ends are swept with those that are open in a heap.
    """
    n, edges = len(gs), np.sort(np.concatenate([gs, ge]))
    edges = edges[np.diff(edges, prepend=edges[:1] - 1) > 0]
    lo, hi = np.searchsorted(edges, gs), np.searchsorted(edges, ge)
    width, best = np.maximum(hi - lo, 0), np.full(len(edges) + 1, n)
    total = int(width.sum())
    if total <= STRETCHES_A_SPAN * n:
        at = np.arange(1, total + 1) + np.repeat(lo - (np.cumsum(width) - width), width)
        best[at[::-1]] = np.repeat(np.arange(n), width)[::-1]
        return edges, best
    begins, open_spans, k = np.argsort(lo, kind="stable").tolist(), [], 0
    lo, hi = lo.tolist(), hi.tolist()
    for i in range(len(edges)):
        while k < n and lo[begins[k]] == i:
            heappush(open_spans, begins[k])
            k += 1
        while open_spans and hi[open_spans[0]] <= i:
            heappop(open_spans)
        best[i + 1] = open_spans[0] if open_spans else n
    return edges, best


#: Stretches that spans may cover on average to be written out.
STRETCHES_A_SPAN = 16


def _first_spans(s: np.ndarray, e: np.ndarray, gs: np.ndarray, ge: np.ndarray) -> np.ndarray:
    """For each token s:e the first span of the list that meets it, else the number of spans."""
    edges, best = stretches(gs, ge)
    ends = np.stack([np.searchsorted(edges, s, "right"), np.searchsorted(edges, e, "left") + 1], axis=1).ravel()
    return np.minimum.reduceat(np.append(best, len(gs)), ends)[::2]


def _tags_of(batch: pa.RecordBatch, spans: list[tuple]) -> np.ndarray:
    """Tags of the tokens of one text by its spans (ord, type, gs, ge)."""
    if not spans:
        return np.full(batch.num_rows, "O", object)
    spans = sorted(spans)
    s, e = (batch.column(c).to_numpy() for c in ("s", "e"))
    gs, ge = (np.array([span[c] for span in spans], np.int64) for c in (2, 3))
    first = _first_spans(s, e, gs, ge)
    begin = np.append(gs, 0)[first]
    inner, outer = (np.array([*(f"{mark}-{kind}" for _, kind, _, _ in spans), "O"], object)[first] for mark in "IB")
    return np.where(s <= begin, outer, inner)


def _tagged(pieces: _Pieces, order: np.ndarray, kind: np.ndarray, gs: np.ndarray, ge: np.ndarray, kinds: list[str]) -> Iterator[pa.RecordBatch]:
    """Tagged tokens of some texts, by spans at places as those of the tokens; kind is a place in the sorted kinds."""
    rank = np.lexsort((gs, kind, order))
    gs, ge, kind = gs[rank], ge[rank], kind[rank]
    tag = np.zeros(len(pieces.s), np.int64)
    if len(gs) and len(tag):
        first = _first_spans(pieces.s, pieces.e, gs, ge)
        hit = np.flatnonzero(first < len(gs))
        own = first[hit]
        tag[hit] = 1 + 2 * kind[own] + (pieces.s[hit] > gs[own])
    names = pa.array(["O", *(f"{mark}-{k}" for k in kinds for mark in "BI")], pa.string())
    return pieces.batches(["key", "pos", "tok", "s", "e", "tag"], names.take(pa.array(tag)))


def _tagged_schema(df: DataFrame, key: str):
    return df.select(F.col(key), F.lit(0).alias("pos"), F.lit("").alias("tok"), F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit("").alias("tag")).schema


def tag_texts(df: DataFrame, surfaces: DataFrame, key: str, text: str = "text", most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(key, pos, tok, s, e, tag) of all texts by one vocabulary (type, surface and maybe ord), as bio_tags of find_spans.

    Up to `most_bytes` of words are looked for where a text is cut, so that neither tokens nor spans are shuffled.
    """
    words = surfaces.where("length(surface) > 0 and type is not null")
    if not small_enough(words, most_bytes=most_bytes):
        return bio_tags(tokens(df, key, text), find_spans(df, words, key, text, most_bytes), key)
    order = F.col("ord").cast("int") if "ord" in words.columns else F.lit(0)
    known = SharedWords(df.sparkSession, [tuple(r) for r in words.select("surface", F.col("type").cast("string"), order.alias("ord")).distinct().collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = known.words()
        kinds = sorted({t for _, t, _ in of})
        code = {k: i for i, k in enumerate(kinds)}
        kind, order, size = (np.array(x, np.int64) for x in ([code[t] for _, t, _ in of], [o for _, _, o in of], [len(w) for w, _, _ in of]))
        for batch in batches:
            for pieces, _ in _pieces(batch):
                rows, hits, ends = (np.array(x, np.int64) for x in known.places(pieces.texts))
                ge = pieces.base[rows] + ends
                yield from _tagged(pieces, order[hits], kind[hits], ge - size[hits], ge, kinds)

    return df.select(key, text).mapInArrow(run, _tagged_schema(df, key))


def tag_own(df: DataFrame, key: str, text: str = "text", entities: str = "entities") -> DataFrame:
    """(key, pos, tok, s, e, tag) of texts by their own entities, an array of (type, text); of overlapping ones the first wins.

    Entities without a type or a text are left out. All is found where a row is read; nothing is shuffled.
    """
    own = F.transform(entities, lambda x: F.struct(x["type"].cast("string").alias("type"), x["text"].alias("surface")))
    return df.select(key, text, own.alias("own")).mapInArrow(_tagged_by_own, _tagged_schema(df, key))


def _tagged_by_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pieces, rows in _pieces(batch):
            spans: list[tuple] = []
            for base, t, own in zip(pieces.base, pieces.texts, rows.column(2).to_pylist(), strict=False):
                for order, x in enumerate(own or ()):
                    kind, surface = (x["type"], x["surface"]) if x else (None, None)
                    at = t.find(surface) if kind is not None and surface else -1
                    while at >= 0:
                        spans.append((order, kind, base + at, base + at + len(surface)))
                        at = t.find(surface, at + len(surface))
            kinds = sorted({k for _, k, _, _ in spans})
            code = {k: i for i, k in enumerate(kinds)}
            order, gs, ge = (np.array([x[c] for x in spans], np.int64) for c in (0, 2, 3))
            yield from _tagged(pieces, order, np.array([code[x[1]] for x in spans], np.int64), gs, ge, kinds)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tagged tokens from rows sorted by key in which a text's spans (kind 0) stand before its tokens (kind 1)."""
    key, spans = None, []
    for batch in batches:
        keys = batch.column(0)
        code = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        kind = batch.column("kind").to_numpy()
        starts = np.flatnonzero((np.diff(code, prepend=code[:1] - 1) != 0) | (np.diff(kind, prepend=-1) != 0)) if batch.num_rows else []
        done = []
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            part, own = batch.slice(lo, hi - lo), keys[lo].as_py()
            if own != key:
                key, spans = own, []
            if kind[lo]:
                done.append((part.select(part.schema.names[:1] + ["pos", "tok", "s", "e"]), _tags_of(part, spans)))
            else:
                spans += zip(*(part.column(c).to_pylist() for c in ("ord", "type", "s", "e")), strict=True)
        if done:
            table = pa.Table.from_batches([p for p, _ in done]).append_column("tag", pa.array(np.concatenate([t for _, t in done]), pa.string()))
            yield from table.combine_chunks().to_batches()


def bio_tags(toks: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, pos, tok, s, e, tag); of overlapping spans the first of the list (ord) wins, then by type, then by start.

    Tokens and spans are dealt by key and met in a sweep, in time linear in both but for sorting: a text's spans are held,
    its tokens pass. Tokens without a key (and spans without one) are of one text.
    """
    order = F.col("ord").cast("int") if "ord" in spans.columns else F.lit(0)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = toks.select(key, F.lit(1).alias("kind"), F.col("pos").cast("int").alias("pos"), "tok", F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"), none("int", "ord"), none("string", "type"))
    rows = rows.union(spans.select(key, F.lit(0), none("int", "pos"), none("string", "tok"), F.col("gs").cast("int"), F.col("ge").cast("int"), order, "type"))
    return rows.repartition(key).sortWithinPartitions(key, "kind").mapInArrow(_swept, _tagged_schema(toks, key))


def decode_bio(tagged: DataFrame, key: str) -> DataFrame:
    """(key, type, s, e): spans of B- followed by I- of the same type; anything else ends a span."""
    w = Window.partitionBy(key).orderBy("pos")
    rows = tagged.withColumn("seg", F.sum(F.col("tag").startswith("B-").cast("int")).over(w)).where("seg > 0")
    in_seg = Window.partitionBy(key, "seg").orderBy("pos")
    kind = F.first(F.substring("tag", 3, 100)).over(in_seg)
    rows = rows.withColumn("type", kind).withColumn("ok", F.min(((F.col("tag").startswith("B-")) | (F.col("tag") == F.concat(F.lit("I-"), F.col("type")))).cast("int")).over(in_seg))
    return rows.where("ok = 1").groupBy(key, "seg", "type").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("seg")


def score_tags(feature_rows: DataFrame, weights: DataFrame, intercepts: DataFrame, key: str) -> DataFrame:
    """(key, pos, class): sums of weights(feature, class, weight) over feature_rows(key, pos, feature, value); unknown features go."""
    base = feature_rows.select(key, "pos").distinct().crossJoin(F.broadcast(intercepts))
    hit = feature_rows.join(weights, "feature").groupBy(key, "pos", "class").agg(F.sum(F.col("value") * F.col("weight")).alias("z"))
    total = base.join(hit, [key, "pos", "class"], "left").withColumn("z", F.coalesce("z", F.lit(0.0)) + F.col("intercept"))
    best = F.row_number().over(Window.partitionBy(key, "pos").orderBy(F.desc("z"), "class"))
    return total.withColumn("k", best).where("k = 1").select(key, "pos", "class")
