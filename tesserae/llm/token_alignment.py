"""Alignment of two tokenizers over the same bytes: a sweep over the ends of both sides' tokens."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import chunks, cut, discard

#: Token ids of one event row, links that are held unsummed, and id pairs whose counts are broadcast (16 bytes each).
BLOCK, LINKS, BROADCAST_PAIRS = 8192, 1 << 20, 2_000_000
MARK = "▁"
EVENTS = pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), ("start", pa.int64()), ("side", pa.int8()), ("ids", pa.binary())])
SWEPT = pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), ("copies", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


# ---------------------------------------------------------------- token bytes


def byte_level(vocabulary: dict[str, int]) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary: printable Latin-1 stands for itself, other bytes for U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden_bytes = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden_bytes)}
    out = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        out[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
    return out


class Sides:
    """Both sides' ids of a text as bytes, or None where a side's joined token bytes differ from space and text.

    With a rank file of side A's vocabulary and its split pattern, the library for these encodes instead.
    """

    def __init__(self, tokenizer_path: str, pieces_path: str, ranks_path: str | None = None, pattern: str | None = None):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(tokenizer_path)
        self.a.encode_special_tokens = True
        self.ranked = None
        if ranks_path:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
            self.ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_a = byte_level(self.a.get_vocab())
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.kinds = tuple(np.uint16 if len(x) <= 1 << 16 else np.uint32 for x in (self.bytes_a, self.bytes_b))

    def encode(self, text: str) -> tuple[bytes, bytes] | None:
        if not text:
            return None
        raw, given = b" " + text.encode(), " " + text
        a = self.ranked(given) if self.ranked else self.a.encode(given, add_special_tokens=False).ids
        b = self.b.encode(text, num_threads=1)
        if b"".join(map(self.bytes_b.__getitem__, b)) != raw or b"".join(map(self.bytes_a.__getitem__, a)) != raw:
            return None
        return np.array(a, self.kinds[0]).tobytes(), np.array(b, self.kinds[1]).tobytes()


_sides: dict[tuple, Sides] = {}


def _loaded(files: dict) -> Sides:
    key = tuple(sorted(files.items()))
    if key not in _sides:
        _sides[key] = Sides(**files)
    return _sides[key]


# ---------------------------------------------------------------- events


def _events(files: dict, lengths: tuple[np.ndarray, np.ndarray]):
    """Event rows of each text: the ids of up to BLOCK tokens of one side, with the byte at which the first starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _loaded(files)
        for batch in chunks(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            for doc_id, same, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "same", "text")), strict=True):
                found = sides.encode(text or "")
                blocks = [(0, -1, b"")]
                if found:
                    blocks = []
                    for side, ids in enumerate(found):
                        size, start = sides.kinds[side]().itemsize, 0
                        for lo in range(0, len(ids), size * BLOCK):
                            part = ids[lo : lo + size * BLOCK]
                            blocks.append((start, side, part))
                            if lo + size * BLOCK < len(ids):
                                start += int(lengths[side][np.frombuffer(part, sides.kinds[side])].sum())
                for start, side, part in blocks:
                    for column, value in zip(out, (doc_id, same, start, side, part), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, EVENTS, strict=True)], schema=EVENTS)

    return run


# ---------------------------------------------------------------- the sweep


class Sweep:
    """One document's tokens in the order of their ends; groups close where both sides end at the same byte.

    It holds the tokens of the group that is open, the hash so far, and the document's distinct links with their numbers.
    """

    def __init__(self, tables: Tables):
        self.tables = tables
        self.ends, self.ids = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2
        self.n, self.groups, self.links = [0, 0], 0, 0
        self.sha, self.held, self.parts = hashlib.sha256(), 0, []

    def add(self, start: int, side: int, ids: np.ndarray) -> None:
        ends = start + np.cumsum(self.tables.lengths[side][ids])
        self.n[side] += len(ids)
        self.ends[side] = np.concatenate([self.ends[side], ends]) if len(self.ends[side]) else ends
        self.ids[side] = np.concatenate([self.ids[side], ids]) if len(self.ids[side]) else ids
        (ends_a, ends_b), (a, b) = self.ends, self.ids
        if not len(ends_a) or not len(ends_b):
            return
        at = np.searchsorted(ends_b, ends_a)
        last_a = np.flatnonzero((at < len(ends_b)) & (ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a))
        if len(last_a):
            last_b = at[last_a]
            self._close(a[: last_a[-1] + 1], b[: last_b[-1] + 1], last_a, last_b)
            for side, k in ((0, last_a[-1]), (1, last_b[-1])):
                self.ends[side], self.ids[side] = self.ends[side][k + 1 :], self.ids[side][k + 1 :]

    def _close(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> None:
        """Groups whose last tokens are last_a and last_b: count, hash and link them."""
        count_a, count_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        text = np.empty(len(a) + len(b), object)
        for ids, plain, ending, last, before, count in ((a, *self.tables.text_a, last_a, last_b + 1 - count_b, count_a), (b, *self.tables.text_b, last_b, last_a + 1, count_b)):
            place = np.arange(len(ids)) + np.repeat(before, count)
            text[place] = plain[ids]
            text[place[last]] = ending[ids[last]]
        if self.groups:
            self.sha.update(b";")
        self.sha.update("".join(text.tolist())[:-1].encode())
        self.groups += len(last_a)
        product = count_a * count_b
        self.links += int(product.sum())
        first_a, first_b = last_a + 1 - count_a, last_b + 1 - count_b
        few = product <= LINKS
        for g in np.flatnonzero(~few):
            (ids_a, times_a), (ids_b, times_b) = (np.unique(x, return_counts=True) for x in (a[first_a[g] : last_a[g] + 1], b[first_b[g] : last_b[g] + 1]))
            for one, times in zip(ids_a, times_a, strict=True):
                self._hold(self.tables.pair(one, ids_b), times * times_b)
        if not few.all():
            count_b, product, first_a, first_b = count_b[few], product[few], first_a[few], first_b[few]
        ends = np.cumsum(product)
        lo = 0
        while lo < len(product):  # as many groups at once as give LINKS links
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + LINKS, "right")))
            n = product[lo:hi]
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(count_b[lo:hi], n)
            self._hold(self.tables.pair(a[np.repeat(first_a[lo:hi], n) + k // width], b[np.repeat(first_b[lo:hi], n) + k % width]), None)
            lo = hi

    def _hold(self, pairs: np.ndarray, times: np.ndarray | None) -> None:
        self.parts.append(_summed(pairs, times))
        self.held += len(self.parts[-1][0])
        if self.held > 2 * LINKS:
            self._together()

    def _together(self) -> None:
        if len(self.parts) > 1:
            self.parts = [_summed(np.concatenate([p for p, _ in self.parts]), np.concatenate([t for _, t in self.parts]))]
        self.held = 0

    def row(self, doc_id: int | None, same: int, copies: int) -> tuple:
        if len(self.ends[0]) or len(self.ends[1]):
            raise ValueError(f"the sides of document {doc_id} end at different bytes")
        self._together()
        pairs, times = self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return doc_id, same, copies, *self.n, self.groups, self.links, self.sha.hexdigest() if self.groups else "", pairs.astype("<i8").tobytes(), times.astype("<i4").tobytes()


def _summed(keys: np.ndarray, values: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their values; without values, with their numbers."""
    if values is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(values, first) if len(first) else values


class Tables:
    """What the sweep needs of the two vocabularies: token lengths, decimal ids with what follows them, pair numbers."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray], kinds: tuple):
        self.lengths, self.kinds = lengths, kinds
        self.text_a, self.text_b = ([np.array([f"{i}{c}" for i in range(len(x))], object) for c in marks] for x, marks in zip(lengths, (",|", ",;"), strict=True))

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.asarray(a, np.int64) * len(self.lengths[1]) + b


def _sweep(lengths: tuple[np.ndarray, np.ndarray], kinds: tuple):
    """A pass over event rows sorted by document, start and side, one document at a time; equal rows count as copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, done, held = Tables(lengths, kinds), [], 0
        doc = sweep = last = None
        copies = 0

        def out() -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SWEPT, strict=True)], schema=SWEPT)

        for batch in batches:
            for doc_id, same, start, side, ids in zip(*(batch.column(n).to_pylist() for n in EVENTS.names), strict=True):
                if (doc_id, same) != doc:
                    if sweep is not None:
                        done.append(sweep.row(*doc, copies))
                        held += len(done[-1][-2])
                        if held > 1 << 21 or len(done) >= 1000:
                            yield out()
                            done, held = [], 0
                    doc, sweep, last, copies = (doc_id, same), Sweep(tables), None, 0
                copies += last in (None, (start, side)) and start == 0 and side <= 0
                if last != (start, side):
                    last = start, side
                    if side >= 0:
                        sweep.add(start, side, np.frombuffer(ids, kinds[side]))
        if sweep is not None:
            done.append(sweep.row(*doc, copies))
        if done:
            yield out()

    return run


# ---------------------------------------------------------------- corpus-wide counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of documents that hold each pair, summed within a task as far as memory allows."""
    parts, held = [], 0

    def out() -> pa.RecordBatch:
        keys, values = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts]))
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values)], ["pair", "docs"])

    for batch in batches:
        for pairs, copies in zip(batch.column("pairs").to_pylist(), batch.column("copies").to_pylist(), strict=True):
            keys = np.frombuffer(pairs, "<i8")
            parts.append((keys, np.full(len(keys), copies, np.int64)))
            held += len(keys)
            if held > 4 * LINKS:
                keys, values = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts]))
                parts, held = [(keys, values)], len(keys)
                if held > 2 * LINKS:
                    yield out()
                    parts, held = [], 0
    if parts:
        yield out()


def _scored(known):
    """Result rows from swept ones by the broadcast counts of all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs, best = known.value
        for batch in chunks(batches, "pairs"):
            rows = batch.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "copies"]).to_pylist()
            for row, held, times in zip(rows, batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True):
                at, times = np.searchsorted(pairs, np.frombuffer(held, "<i8")), np.frombuffer(times, "<i4").astype(np.int64)
                row["n_best"], row["count_sum"] = int(times[best[at]].sum()), int((times * docs[at]).sum())
            names = [x.split()[0] for x in RESULT.split(", ")]
            for lo in range(0, len(rows), 1000):
                yield from _repeated(rows[lo : lo + 1000], names)

    return run


def _repeated(rows: list[dict], names: list[str]) -> Iterator[pa.RecordBatch]:
    flat = (row for row in rows for _ in range(row["copies"]))
    while some := [row for _, row in zip(range(10_000), flat)]:
        yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in some], pa.string() if n == "groups_sha256" else pa.int64()) for n in names})


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "pairs", 1 << 18):
        sizes = [len(p) // 8 for p in batch.column("pairs").to_pylist()]
        doc_id, same = (np.repeat(np.arange(batch.num_rows), sizes) for _ in range(2))
        pairs = np.frombuffer(b"".join(batch.column("pairs").to_pylist()), "<i8")
        times = np.frombuffer(b"".join(batch.column("times").to_pylist()), "<i4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc_id)), batch.column("same").take(pa.array(same)), pa.array(pairs), pa.array(times)], ["doc_id", "same", "pair", "times"])


def align_tokens(docs: DataFrame, files: dict, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs(doc_id, text).

    Byte offsets at which tokens of both tokenizers (`files`: see Sides) end cut them into groups; tokens of one group are
    linked. An id pair's count is the number of documents that hold it linked. Events of both sides (ids of up to BLOCK
    tokens with the byte where they start) are dealt by document, sorted by that byte, and swept as a stream, so a long
    text costs the memory of its distinct links and of one open group.

    Texts null, empty, or not given back byte by byte by both sides have no tokens: zeros and an empty string. Rows that
    repeat both doc_id and text give one result each and count as documents each; unlike texts under one doc_id, or under
    none, are documents of their own. doc_id is a whole number. Ties for an A id's highest count are all best. Other
    columns are ignored. Counts of at most `broadcast_pairs` id pairs are broadcast; beyond that, links meet them in a
    join.
    """
    spark = docs.sparkSession
    sides = _loaded(files)
    lengths = tuple(np.array([len(t) for t in x], np.int64) for x in (sides.bytes_a, sides.bytes_b))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("same"), "text")
    events = rows.mapInArrow(_events(files, lengths), "doc_id long, same long, start long, side byte, ids binary")
    swept = cut(events.repartition("doc_id", "same").sortWithinPartitions("doc_id", "same", "start", "side").mapInArrow(_sweep(lengths, sides.kinds), "doc_id long, same long, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"))
    counts = swept.select("pairs", "copies").mapInArrow(_counted, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = cut(counts)
    a = F.expr(f"pair div {len(lengths[1])}")
    highest = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("highest"))
    known = counts.withColumn("a", a).join(highest, "a").select("pair", "docs", (F.col("docs") == F.col("highest")).alias("best"))
    if counts.count() <= broadcast_pairs:
        table = known.toArrow()
        order = np.argsort(table["pair"].to_numpy())
        shared = spark.sparkContext.broadcast((table["pair"].to_numpy()[order], table["docs"].to_numpy()[order], table["best"].combine_chunks().to_numpy(zero_copy_only=False)[order]))
        discard(counts)
        return swept.mapInArrow(_scored(shared), RESULT)
    links = swept.select("doc_id", "same", "pairs", "times").mapInArrow(_exploded, "doc_id long, same long, pair long, times long").join(known, "pair")
    sums = links.groupBy("doc_id", "same").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum")).toDF("d", "s", "n_best", "count_sum")
    found = swept.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).join(sums, (F.col("same") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
