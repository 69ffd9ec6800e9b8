"""Many words looked for in many texts at once: an Aho-Corasick automaton that each task walks along its texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of words that are broadcast and built into one automaton (some 40 times that in a worker).
AUTOMATON_BYTES = 4 << 20
_built: dict[str, tuple] = {}


def _automaton(name: str, shared) -> tuple:
    """The automaton over a broadcast list of (word, tag, ..), each word with its places in the list; built once a worker."""
    if name not in _built:
        _built.clear()
        tree, places = ahocorasick.Automaton(), {}
        for i, (word, *_) in enumerate(shared.value):
            places.setdefault(word, []).append(i)
        for word, at in places.items():
            tree.add_word(word, at)
        if places:
            tree.make_automaton()
        words, tags = (pa.array([p[k] for p in shared.value], pa.string()) for k in (0, 1))
        _built[name] = (tree, words, tags)
    return _built[name]


def small_enough(words: DataFrame, word: str = "surface", most_bytes: int = AUTOMATON_BYTES) -> bool:
    return (words.agg(F.sum(F.octet_length(word) + 8)).first()[0] or 0) <= most_bytes


def contained(texts: DataFrame, words: DataFrame, key: str, text: str = "text", word: str = "surface", tag: str = "type") -> DataFrame:
    """(key, tag, word): each of words(word, tag) that a text contains, once a text; a scan whose cost is the texts' length.

    The words are broadcast: see small_enough. Null texts and empty words contain nothing and are contained in nothing;
    equal words of several tags, and rows that repeat a text, give a row each.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in words.select(word, F.col(tag).cast("string")).where(F.length(word) > 0).collect()])
    name = uuid.uuid4().hex
    schema = texts.select(F.col(key), F.lit("").alias(tag), F.lit("").alias(word)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, known, tags = _automaton(name, shared)
        for batch in batches:
            rows, hits = [], []
            if len(known):
                for row, t in enumerate(batch.column(1).to_pylist()):
                    found = {i for _, at in tree.iter(t) for i in at} if t else ()
                    rows.extend([row] * len(found))
                    hits.extend(found)
            at = pa.array(hits, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), tags.take(at), known.take(at)], [key, tag, word])

    return texts.select(key, text).mapInArrow(run, schema)


class SharedWords:
    """Words (word, tag, ord) that are broadcast, and where they stand in texts; a task builds their automaton once."""

    def __init__(self, spark, held: list[tuple]):
        self.shared, self.name = spark.sparkContext.broadcast(held), uuid.uuid4().hex

    def words(self) -> list[tuple]:
        return self.shared.value

    def places(self, texts: list[str | None]) -> tuple[list[int], list[int], list[int]]:
        """(rows, hits, ends): the text, the word's place in the list and where it ends; those of one word do not overlap, the first counts."""
        tree, known, _ = _automaton(self.name, self.shared)
        sizes = [len(w[0]) for w in self.shared.value]
        rows, hits, ends = [], [], []
        if len(known):
            for row, t in enumerate(texts):
                free: dict[int, int] = {}  # where the next place of a word may begin
                for last, at in tree.iter(t) if t else ():
                    if last + 1 - sizes[at[0]] >= free.get(at[0], 0):
                        free[at[0]] = last + 1
                        for i in at:
                            rows.append(row)
                            hits.append(i)
                            ends.append(last + 1)
        return rows, hits, ends


def occurrences(texts: DataFrame, words: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, type, surface, ord, gs, ge): where each of words(surface, type, ord) stands in each text, from one scan.

    Places of one word do not overlap, the first counts; offsets are in characters from 0. The words are broadcast.
    """
    held = words.where(F.length("surface") > 0).select("surface", F.col("type").cast("string"), F.col("ord").cast("int")).collect()
    found = SharedWords(texts.sparkSession, [tuple(r) for r in held])
    schema = texts.select(F.col(key), F.lit("").alias("type"), F.lit("").alias("surface"), F.lit(0).alias("ord"), F.lit(0).alias("gs"), F.lit(0).alias("ge")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tags, orders = (pa.array([w[k] for w in found.words()], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32())))
        lengths = pc.utf8_length(known)
        for batch in batches:
            rows, hits, ends = found.places(batch.column(1).to_pylist())
            at, ge = pa.array(hits, pa.int64()), pa.array(ends, pa.int32())
            gs = pc.subtract(ge, lengths.take(at))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), tags.take(at), known.take(at), orders.take(at), gs, ge], ["key", "type", "surface", "ord", "gs", "ge"])

    return texts.select(key, text).mapInArrow(run, schema)
