"""Vector bin packing of tokenised documents under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import base64
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents that wait at once in a task, and words whose ids a task remembers.
POOL, REMEMBERED = 256, 150_000
EDGE_SPACE = re.compile(r"^\s|\s$")


class Encoder:
    """Ids of a tokenizers file as little-endian 32-bit bytes.

    With a rank file of the same vocabulary and its split pattern, what stands between single spaces is encoded once
    and remembered: the pattern gives such a stretch the same pieces wherever it stands. Texts where that does not hold
    (runs of white space around a space, special tokens) are encoded whole.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, special: tuple[str, ...] = ()):
        self.path, self.special = tokenizer_path, special
        self._whole = None
        self._ordinary = None
        if ranks_path:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
            self._ordinary = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self._cache: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return np.asarray(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self._ordinary is None or any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = text.split(" ")
        if EDGE_SPACE.search(first):
            return array("I", self._ordinary(text)).tobytes()
        cache, out = self._cache, [array("I", self._ordinary(first)).tobytes()]
        for word in rest:
            ids = cache.get(word)
            if ids is None:
                if not word or EDGE_SPACE.search(word):
                    return array("I", self._ordinary(text)).tobytes()
                ids = array("I", self._ordinary(" " + word)).tobytes()
                if len(cache) >= REMEMBERED:
                    cache.clear()
                cache[word] = ids
            out.append(ids)
        return b"".join(out)


class Packer:
    """Packs a stream of documents; finished sequences leave as lists of pieces (row, start, ids).

    A document's tokens before loss_from (its prompt) bear no loss. Waiting ones are rows of three sizes: tokens, one
    segment, loss-bearing tokens.
    """

    def __init__(self, tokens: int, segments: int, loss: int, pool: int = POOL):
        if min(tokens, segments, loss, pool) < 1:
            raise ValueError("limits are 1 at least")
        self.limit, self.pool = np.array([tokens, segments, loss]), pool
        self.items: list[tuple] = []  # (row, ids bytes, first position that bears loss)
        self.start: list[int] = []
        self.size = np.zeros((pool + 1, 3), np.int64)
        self.share = np.zeros((pool + 1, 3))

    def _loss(self, start: int, length: int, loss_from: int) -> int:
        return max(0, start + length - max(start, loss_from))

    def _set(self, i: int, start: int) -> None:
        _, ids, loss_from = self.items[i]
        length = len(ids) // 4 - start
        self.start[i] = start
        self.size[i] = length, 1, self._loss(start, length, loss_from)
        self.share[i] = self.size[i] / self.limit

    def _cut(self, i: int, length: int) -> tuple:
        """The next `length` tokens of a waiting document, which goes when none are left."""
        row, ids, _ = self.items[i]
        start = self.start[i]
        if 4 * (start + length) < len(ids):
            self._set(i, start + length)
        else:
            last = len(self.items) - 1
            self.items[i], self.start[i] = self.items[last], self.start[last]
            self.size[i], self.share[i] = self.size[last], self.share[last]
            self.items.pop()
            self.start.pop()
        return row, start, ids[4 * start : 4 * (start + length)]

    def add(self, row, ids: bytes, loss_from: int):
        tokens, start = int(self.limit[0]), 0
        while len(ids) // 4 - start >= tokens and self._loss(start, tokens, loss_from) <= self.limit[2]:
            yield [(row, start, ids[4 * start : 4 * (start + tokens)])]
            start += tokens
        if 4 * start < len(ids):
            self.items.append((row, ids, loss_from))
            self.start.append(start)
            self._set(len(self.items) - 1, start)
        while len(self.items) >= self.pool:
            yield from self.bin()

    def bin(self):
        """One sequence: the document with the largest dot product of its size and what is left, again and again.

        Sizes and rooms count as shares of their limits. Where none fits whole, the one of which most fits is cut. Of
        equal ones the first counts.
        """
        left, chosen = self.limit.copy(), []
        while self.items and left[0] > 0 and left[1] > 0:
            size = self.size[: len(self.items)]
            fits = (size[:, 0] <= left[0]) & (size[:, 2] <= left[2])
            if fits.any():
                i = int(np.argmax(np.where(fits, self.share[: len(self.items)] @ (left / self.limit), -1.0)))
                length = int(size[i, 0])
            else:
                some = np.minimum(np.minimum(size[:, 0], left[0]), size[:, 0] - size[:, 2] + left[2])
                i = int(np.argmax(some))
                length = int(some[i])
                if length <= 0:
                    break
            loss_from = self.items[i][2]
            left -= [length, 1, self._loss(self.start[i], length, loss_from)]
            chosen.append(self._cut(i, length))
        yield from self.trimmed(chosen)

    def trimmed(self, chosen: list[tuple]):
        """A full sequence as it is; a shorter one in sequences of powers of two, which need no padding."""
        total = sum(len(p[2]) // 4 for p in chosen)
        while total:
            room = total if total == self.limit[0] else 1 << (total.bit_length() - 1)
            total -= room
            now = []
            while room:
                row, start, ids = chosen.pop(0)
                length = min(room, len(ids) // 4)
                now.append((row, start, ids[: 4 * length]))
                if 4 * length < len(ids):
                    chosen.insert(0, (row, start + length, ids[4 * length :]))
                room -= length
            yield now

    def finish(self):
        while self.items:
            yield from self.bin()


def pack(docs: DataFrame, encoder: dict, end_id: int = 1, tokens: int = 2048, segments: int = 256, loss: int | None = None, prompt: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens[, ids]): the pieces of all docs.

    encoder holds the arguments of Encoder. Each text's ids end with end_id; null and empty texts are that id alone, and
    every row of docs, repeated ones and those without doc_id too, is packed once; an empty table gives an empty one.
    Tokens from a row's loss_from on bear loss (without that column, or where it is null, from the token number `prompt`
    on or from its middle, whichever comes first, but not the first token). A sequence holds at most `tokens` tokens, `segments` pieces and `loss` (else `tokens`)
    loss-bearing tokens. Each task packs what it scans, holding POOL documents, and no row is shuffled. sequence_id is
    the scan's partition and a number within it. Columns but doc_id, text and loss_from are not read.
    """
    loss_column = "loss_from" in docs.columns
    source = docs.select(F.col("doc_id").cast("long"), "text", F.col("loss_from").cast("long") if loss_column else F.lit(None).cast("long").alias("loss_from"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"] + ["ids"] * with_ids
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        encode = Encoder(**encoder).encode
        packer = Packer(tokens, segments, tokens if loss is None else loss)
        number = TaskContext.get().partitionId() << 40
        out: list[tuple] = []

        def emit(sequences):
            nonlocal number
            for pieces in sequences:
                offset = 0
                for (doc, total, loss_from), start, ids in pieces:
                    n = len(ids) // 4
                    out.append((doc, start, n, zlib.crc32(ids), total, number, offset, packer._loss(start, n, loss_from), ids))
                    offset += n
                number += 1

        def flush():
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns[:8]]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[8]], pa.list_(pa.int32())))
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for doc, text, loss_from in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = (encode(text) if text else b"") + end
                first = max(1, min(prompt, len(ids) // 8)) if loss_from is None else loss_from
                emit(packer.add((doc, len(ids) // 4, first), ids, first))
                if len(out) >= 5000:
                    yield flush()
        emit(packer.finish())
        if out:
            yield flush()

    return source.mapInArrow(run, ", ".join(f"`{n}` {'array<int>' if n == 'ids' else 'long'}" for n in names))
