"""Document fingerprints from prefix polynomial hashes: any span's hash, and so any equality, from two array reads."""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import U64, mix

#: Two primes below 2**31 with their bases: products fit 64 bits.
MODULI = ((2147483647, 911382323), (2147483629, 972663749))
#: Code points of a span, anchors kept of each text, code points that a task holds at once. Anchors are spans whose hash is
#: 0 modulo ANCHORS: what is chosen depends on the content alone. The first of the doubling lengths around an anchor.
SPAN, KEPT, CHUNK, ANCHORS, LEAST = 20, 16, 1 << 19, 16, 8
#: Most ranges of doc_id; the first id of each goes to all tasks.
BUCKETS = 50_000
#: The most that unequal texts get.
UNEQUAL = 1 - 1 / 1024
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse, up to n."""
    if not _tables or len(_tables[0][0]) <= n:
        size = 1 << max(17, n.bit_length())
        _tables.clear()
        for p, base in MODULI:
            both = []
            for b in (base, pow(base, -1, p)):
                out, have = np.ones(size, U64), 1
                while have < size:
                    out[have : 2 * have] = out[:have] * U64(pow(b, have, p)) % U64(p)
                    have *= 2
                both.append(out)
            _tables.append(tuple(both))
    return _tables


class PrefixHashes:
    """Prefix arrays over code points; the hash of [i, j) does not depend on where the span stands."""

    def __init__(self, text: str | np.ndarray):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32) if isinstance(text, str) else text
        self.n = len(codes)
        self.sums = []
        for (p, _), (power, _) in zip(MODULI, _powers(self.n + 1), strict=True):
            terms = (codes.astype(U64) + U64(1)) * power[: self.n] % U64(p)
            self.sums.append(np.concatenate([np.zeros(1, U64), np.cumsum(terms, dtype=U64) % U64(p)]))

    def spans(self, start, end) -> np.ndarray:
        """62-bit hashes of the spans [start, end); start and end may be arrays."""
        out = None
        for (p, _), (_, inverse), s in zip(MODULI, _powers(self.n + 1), self.sums, strict=True):
            h = (s[end] + U64(p) - s[start]) % U64(p) * inverse[start] % U64(p)
            out = h if out is None else out << U64(31) | h
        return out

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all spans of this width, by their start."""
        at = np.arange(max(0, self.n - width + 1))
        return self.spans(at, at + width)

    def equal(self, i: int, j: int, other: PrefixHashes, k: int) -> bool:
        """Whether [i, j) here equals the span of that length from k on in other."""
        return self.spans(i, j) == other.spans(k, k + j - i)

    def extensions(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Lengths of the longest common extensions from i and from j on (or up to them), `most` at most, by binary search."""
        low, high = np.zeros(len(i), np.int64), np.maximum(np.asarray(most, np.int64), 0)
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo] + 1) // 2
            a, b = (i[todo] - middle, j[todo] - middle) if back else (i[todo], j[todo])
            same = self.spans(a, a + middle) == self.spans(b, b + middle)
            low[todo[same]], high[todo[~same]] = middle[same], middle[~same] - 1
            todo = todo[low[todo] < high[todo]]
        return low

    def extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """Length of the longest common extension from i here and j in another text, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(i, i + middle, other, j) else (low, middle - 1)
        return low


def join_hashes(first: int, n_first: int, second: int) -> int:
    """Hash of two spans one after the other from theirs."""
    out = 0
    for k, ((p, _), (power, _)) in enumerate(zip(MODULI, _powers(n_first + 1), strict=True)):
        shift = 31 * (1 - k)
        out |= ((first >> shift & 0x7FFFFFFF) + int(power[n_first]) * (second >> shift & 0x7FFFFFFF)) % p << shift
    return out


@dataclass
class Prints:
    """Fingerprints of some texts: lengths, whole hashes, and what is around each text's anchors.

    An anchor has its span's hash (value), its position, and hashes of the LEAST * 2^k code points that follow its start
    (right) and precede it (left), k < levels; where the text is too short, of what there is. The last two of the anchors
    of a text are its start and its end, so that texts without a span have something to compare.
    """

    n: np.ndarray
    whole: np.ndarray
    count: np.ndarray
    value: np.ndarray
    at: np.ndarray
    right: np.ndarray
    left: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Prints:
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(n) - n
        hashes = PrefixHashes("".join(texts))
        spans = hashes.windows(SPAN)
        at = np.flatnonzero(mix(spans, 9) % U64(ANCHORS) == 0)
        of = np.searchsorted(begin, at, side="right") - 1
        inside = at + SPAN <= begin[of] + n[of]
        at, of = at[inside], of[inside]
        value = (mix(spans[at], 5) >> U64(32)).astype(np.uint32)
        order = np.lexsort((at, value, of))
        at, of, value = at[order], of[order], value[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
        at, of, value = at[fresh], of[fresh], value[fresh]
        place = np.arange(len(at)) - np.searchsorted(of, of)
        kept = place < KEPT
        at, of, value, place = at[kept], of[kept], value[kept], place[kept]
        deep = int(levels(n).max(initial=1))
        out = cls(n, hashes.spans(begin, begin + n), np.bincount(of, minlength=len(n)), np.zeros((len(n), KEPT), np.uint32), np.zeros((len(n), KEPT + 2), np.int64), np.zeros((len(n), KEPT + 2, deep), np.uint16), np.zeros((len(n), KEPT + 2, deep), np.uint16))
        out.value[of, place], out.at[of, place], out.at[:, KEPT + 1] = value, at - begin[of], n
        rows = np.arange(len(n))
        of, place, at = np.concatenate([of, rows, rows]), np.repeat([0, KEPT, KEPT + 1], [len(of), len(n), len(n)]) + np.concatenate([place, rows * 0, rows * 0]), np.concatenate([at, begin, begin + n])
        for k in range(deep):
            some = np.flatnonzero(levels(n)[of] > k)
            x, lo = at[some], begin[of[some]]
            for side, (i, j) in ((out.right, (x, np.minimum(x + (LEAST << k), lo + n[of[some]]))), (out.left, (np.maximum(x - (LEAST << k), lo), x))):
                side[of[some], place[some], k] = (mix(hashes.spans(i, j), 7) >> U64(48)).astype(np.uint16)
        return out

    def written(self) -> list[str]:
        out = []
        for i, (n, whole, count, deep) in enumerate(zip(self.n.tolist(), self.whole.tolist(), self.count.tolist(), levels(self.n).tolist(), strict=True)):
            held = [*range(count), KEPT, KEPT + 1]
            body = self.value[i, :count].astype("<u4").tobytes() + self.at[i, :count].astype("<u4").tobytes() + self.right[i, held, :deep].astype("<u2").tobytes() + self.left[i, held, :deep].astype("<u2").tobytes()
            out.append(f"{n:x}-{whole:016x}-{base64.b64encode(body).decode()}")
        return out

    @classmethod
    def read(cls, texts: list[str]) -> Prints:
        heads = [t.split("-", 2) for t in texts]
        n = np.array([int(h[0], 16) for h in heads], np.int64)
        deep = int(levels(n).max(initial=1))
        out = cls(n, np.array([int(h[1], 16) for h in heads], U64), np.zeros(len(n), np.int64), np.zeros((len(n), KEPT), np.uint32), np.zeros((len(n), KEPT + 2), np.int64), np.zeros((len(n), KEPT + 2, deep), np.uint16), np.zeros((len(n), KEPT + 2, deep), np.uint16))
        out.at[:, KEPT + 1] = n
        for i, own in enumerate(levels(n).tolist()):
            body = base64.b64decode(heads[i][2])
            count = (len(body) - 8 * own) // (8 + 4 * own)
            held, sides = [*range(count), KEPT, KEPT + 1], np.frombuffer(body, "<u2", offset=8 * count).reshape(2, count + 2, own)
            out.count[i], out.value[i, :count], out.at[i, :count] = count, np.frombuffer(body, "<u4", count), np.frombuffer(body, "<u4", count, 4 * count)
            out.right[i, held, :own], out.left[i, held, :own] = sides
        return out

    def rows(self, i) -> Prints:
        return Prints(*(getattr(self, f.name)[i] for f in fields(self)))


def levels(n: np.ndarray) -> np.ndarray:
    """Doubling lengths from LEAST on until one covers n code points, one at least."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / LEAST))).astype(np.int64) + 1


def _agreeing(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many of the first `most` hashes of each row agree, by binary search: longer spans agree only if shorter do."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    rows = np.arange(len(a))
    while (todo := low < high).any():
        middle = (low + high + 1) // 2
        same = a[rows, middle - 1] == b[rows, middle - 1]
        low, high = np.where(todo & same, middle, low), np.where(todo & ~same, middle - 1, high)
    return low


def alike(a: Prints, b: Prints) -> np.ndarray:
    """Likeness of each row of a to that of b: the share of both texts' code points in the common spans that these show.

    Anchors that both hold, their starts and their ends are extended to both sides as far as the hashes of doubling
    lengths agree. Equal fingerprints get 1, others UNEQUAL at most.
    """
    live = (np.arange(KEPT) < a.count[:, None])[:, :, None] & (np.arange(KEPT) < b.count[:, None])[:, None, :]
    row, i, j = np.nonzero((a.value[:, :, None] == b.value[:, None, :]) & live)
    every = np.arange(len(a.n))
    row, i, j = (np.concatenate([x, y, z]) for x, y, z in ((row, every, every), (i, every * 0 + KEPT, every * 0 + KEPT + 1), (j, every * 0 + KEPT, every * 0 + KEPT + 1)))
    span = np.where(i < KEPT, SPAN, 0)
    most = np.minimum(levels(a.n), levels(b.n))[row]
    x, y, n_a, n_b = a.at[row, i], b.at[row, j], a.n[row], b.n[row]
    reach = lambda agreeing, room: np.minimum(np.where(agreeing > 0, LEAST << np.maximum(agreeing - 1, 0), 0), room)
    right = np.maximum(span, reach(_agreeing(a.right[row, i], b.right[row, j], most), np.minimum(n_a - x, n_b - y)))
    left = reach(_agreeing(a.left[row, i], b.left[row, j], most), np.minimum(x, y))
    covered = _covered(row, x - left, x + right, n_a) + _covered(row, y - left, y + right, n_b)
    total = np.bincount(row, covered, len(a.n))
    same = (a.n == b.n) & (a.whole == b.whole)
    return np.where(same, 1.0, np.minimum(UNEQUAL, total / np.maximum(a.n + b.n, 1)))


def _covered(row: np.ndarray, start: np.ndarray, end: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each span what it covers of its row's text that no span before it does."""
    order = np.lexsort((start, row))
    base = row[order] * (int(n.max(initial=0)) + 1)
    lo, hi = base + start[order], base + end[order]
    before = np.concatenate([[0], np.maximum.accumulate(hi)[:-1]]) if len(hi) else hi
    out = np.zeros(len(row), np.int64)
    out[order] = np.maximum(0, hi - np.maximum(lo, before))
    return out


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, from these alone: see alike."""
    return float(alike(Prints.read([a]), Prints.read([b]))[0])


def _pairs(docs: list[tuple[int | None, str, bool]]):
    """For consecutive (doc_id, text, linked to the next): the row of each linked document."""
    texts = [t for _, t, _ in docs]
    linked = [i for i in range(len(docs) - 1) if docs[i][2]]
    edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in linked]
    own, other = Prints.of(texts), Prints.of(edited)
    mine = own.rows(linked)
    near = alike(mine, other), alike(mine, own.rows([i + 1 for i in linked]))
    for k, (one, changed, near_edited, near_next) in enumerate(zip(mine.written(), other.written(), *near, strict=True)):
        i = linked[k]
        yield docs[i][0], len(texts[i]), hashlib.sha256(edited[k].encode()).hexdigest(), one, changed, float(near_edited), float(near_next)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, buckets: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Fingerprints of every whole text of docs(doc_id, text), of its edited text, and likenesses; one row a row.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all) of the next document in
    descending doc_id, after the last one of the first. Null texts are empty. Rows that repeat a doc_id follow each other
    by text; rows without doc_id come last. Every row has its own, empty texts and repeated rows too; an empty table gives
    an empty one, and columns but doc_id and text are not read. A fingerprint holds the length and the polynomial hash of
    the text, the hashes and positions of the KEPT least anchors (see Prints) and of its start and end, with the hashes of
    doubling extensions of each to both sides. Equal texts have equal ones.

    near_edited and near_next are likeness() of the fingerprint to the edited text's and to the next document's: the share
    of both texts that common spans cover, from the longest extensions of common anchors, found by binary search.

    One shuffle deals documents into ranges of doc_id, each with a copy of the next range's first document; the ranges
    come from approximate quantiles. What a task holds at once is bounded by `chunk` code points and one text.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or min(3 * parts, BUCKETS)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 4 * buckets).alias("q")).first()["q"] if buckets > 1 else []
    cuts = np.unique(np.array(cuts if cuts is not None else [], np.int64))

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        whole = ids.fillna(np.iinfo(np.int64).min).astype("int64").to_numpy()
        return pd.Series(len(cuts) - np.searchsorted(cuts, whole), dtype="int32")

    ids = docs.select("doc_id").withColumn("bucket", bucket_of("doc_id"))
    firsts = ids.groupBy("bucket").agg(F.max("doc_id").alias("first")).orderBy("bucket").collect()  # a row a bucket
    before = [(r["first"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]
    linked = F.broadcast(spark.createDataFrame(before, "first long, before int"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("head"))
    targets = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(True).alias("head"))))
    dealt = docs.withColumn("bucket", bucket_of("doc_id")).join(linked, F.col("doc_id").eqNullSafe(F.col("first")), "left")
    dealt = dealt.select("doc_id", "text", F.explode(targets).alias("t")).select("doc_id", "text", "t.bucket", "t.head")
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "head", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches):
        held: list[tuple] = []  # (doc_id, text, linked to the next)
        bucket, closed, size = None, True, 0

        def flush(last: bool):
            nonlocal held, size
            rows = list(_pairs(held)) if len(held) > 1 else []
            held, size = ([] if last else held[-1:]), 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) if k else pa.array(c, pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for doc, text, now, head in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now != bucket:
                    bucket, closed = now, False
                    if held:
                        held[-1] = (*held[-1][:2], False)
                elif closed:
                    continue
                closed = head
                held.append((doc, text, not head))
                size += len(text)
                if size > chunk:
                    yield from flush(False)
        yield from flush(True)

    return dealt.mapInArrow(run, SCHEMA)
