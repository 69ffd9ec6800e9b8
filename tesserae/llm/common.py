"""What several operators share: scratch tables, bounded Arrow chunks, word hashes, Bloom filters, components."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.session import table

__all__ = ["table"]

U64 = np.uint64
#: Bytes of text that a Python worker holds as numpy arrays at once.
CHUNK_BYTES = 1 << 20


# ---------------------------------------------------------------- scratch tables


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    Where that setting is missing, a temporary folder takes its place if driver and executors are one process (a local
    master, as in tests); on a cluster it is an error, since executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\[]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tesserae-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/t-{uuid.uuid4().hex}"


#: Spark's own settings while a table is cut: shuffle files of a query go when it ends, not when the driver collects its
#: garbage; and Arrow batches of at most so many rows, so that of texts some MB lie in a worker and in its executor.
SHUFFLE_CLEANUP, BATCH_ROWS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"
WHILE_CUT = {SHUFFLE_CLEANUP: "true", BATCH_ROWS: "2000"}


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends here and survives lost executors.

    The write's shuffle files go with its end, since nothing after it reads them.
    """
    spark = df.sparkSession
    path, before = scratch(spark), {name: spark.conf.get(name, None) for name in WHILE_CUT}
    try:
        for name, value in WHILE_CUT.items():
            spark.conf.set(name, value)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what cut() wrote for frames that no later plan reads."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def hidden(columns: list[str], *names: str) -> list[str]:
    """Names for columns of our own that none of the given columns has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


# ---------------------------------------------------------------- Arrow helpers


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes in `column` each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column)
        lengths = np.asarray(pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False), np.int64)
        group = np.cumsum(lengths + 16) // limit
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(lo, hi - lo)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x if x is not None else b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


# ---------------------------------------------------------------- word hashes

#: ASCII white space that separates words.
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
KEEP = np.arange(256, dtype=np.uint8)
LOWER = KEEP.copy()
LOWER[65:91] += 32
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: U64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _powers[name] = have
    return have[:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser over unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        h = h + U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


class Words:
    """The words (runs without ASCII white space) of some texts: byte spans, 64-bit hashes, first word of each text."""

    def __init__(self, texts: list[bytes], fold: bool = True):
        blob = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_start = np.concatenate([[1], 1 + np.cumsum(lengths + 1)])
        word = ~IS_SPACE[blob]
        change = np.flatnonzero(word[1:] != word[:-1]) + 1
        self.start, self.end = change[0::2], change[1::2]
        n = len(blob)
        with np.errstate(over="ignore"):
            self.bytes = (LOWER if fold else KEEP)[blob]
            weighted = (self.bytes.astype(U64) + U64(1)) * _power("base", BASE, n)
            self.total = np.concatenate([np.zeros(1, U64), np.cumsum(weighted, dtype=U64)])
        self.hash = self.spans(self.start, self.end)
        self.first = np.searchsorted(self.start, self.text_start)  # first[i]:first[i + 1] are text i's words

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans of the joined texts."""
        with np.errstate(over="ignore"):
            return mix((self.total[end] - self.total[start]) * _power("inverse", BASE_INVERSE, len(self.total))[start])

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on, across texts too; the last n - 1 words have none."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, U64)
        out = np.zeros(m, U64)
        with np.errstate(over="ignore"):
            for k in range(n):
                out = out * BASE + self.hash[k : k + m]
        return mix(out, n)


# ---------------------------------------------------------------- Bloom filters

BLOOM_SLICES = 64
BLOOM_PROBES = 6


def _bits(h: np.ndarray, n_bits: int) -> np.ndarray:
    """Positions of each hash: BLOOM_PROBES within one block of 512 bits."""
    block = (mix(h, 11) % U64(n_bits >> 9)) << U64(9)
    inner = mix(h, 12)
    return np.stack([block | ((inner >> U64(9 * k)) & U64(511)) for k in range(BLOOM_PROBES)])


class Bloom:
    """A blocked Bloom filter of 64-bit keys; misses none, and lets few others through."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, keys: np.ndarray) -> np.ndarray:
        bits = _bits(keys.astype(np.int64).view(U64), len(self.words) * 64)
        found = np.ones(len(keys), bool)
        for row in bits:
            found &= (self.words[row >> U64(6)] >> (row & U64(63)) & U64(1)).astype(bool)
        return found


def bloom(keys: DataFrame, count: int, largest_bits: int = 1 << 30) -> Bloom:
    """A Bloom filter over the one long column of `keys`, 16 bits a key, at most `largest_bits` bits (128 MB).

    Each slice of the bits is built by one task; the driver receives the slices in one job, so what it holds is bounded
    by largest_bits. Beyond that bound the filter only lets more rows through.
    """
    name = keys.columns[0]
    n_bits = min(max(1 << 20, 1 << (16 * max(1, count) - 1).bit_length()), largest_bits)
    per_slice = n_bits // BLOOM_SLICES

    def spread(batches):
        for batch in batches:
            h = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            part = (_bits(h.view(U64), n_bits)[0] // U64(per_slice)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(part)], ["key", "part"])

    def build(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            h = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64).view(U64)
            which = batch.column(1).to_numpy(zero_copy_only=False)
            for part in np.unique(which):
                words = parts.setdefault(int(part), np.zeros(per_slice // 64, U64))
                bits = _bits(h[which == part], n_bits) - U64(int(part) * per_slice)
                for row in bits:
                    np.bitwise_or.at(words, row >> U64(6), U64(1) << (row & U64(63)))
        for part, words in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(words.tobytes(), 1)], pa.binary())], ["part", "bits"])

    slices = keys.select(F.col(name).alias("key")).where("key is not null").mapInArrow(spread, "key long, part int").repartition("part").mapInArrow(build, "part int, bits binary")
    words = np.zeros(n_bits // 64, U64)
    for row in slices.collect():
        at = row["part"] * per_slice // 64
        words[at : at + per_slice // 64] = np.frombuffer(zlib.decompress(row["bits"]), U64)
    return Bloom(words)


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, component) of every id in the long columns (u, v) of edges; component is the smallest id reachable.

    Alternating large-star and small-star steps; each step's edges are a written table, so a lost executor costs no
    more than one step. Hubs meet pre-aggregated minima in joins that adaptive execution splits.
    """
    e = cut(edges.where("u <> v").select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).distinct())
    for _ in range(rounds):
        if _are_stars(e):
            break
        both = e.union(e.select("hi", "lo")).toDF("x", "y")
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("m").alias("lo"), F.col("y").alias("hi")).where("lo < hi").distinct()
        large = cut(large)
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct("m", "lo"), F.struct("m", F.col("hi").alias("lo")))).alias("p")).select("p.m", "p.lo").toDF("lo", "hi")
        step = cut(small.where("lo < hi").distinct())
        discard(e, large)
        e = step
    else:
        raise RuntimeError("components did not settle")
    out = e.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    out = out.union(e.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
    return out


def _are_stars(e: DataFrame) -> bool:
    """Whether each id is either a center or a leaf of one center, so that the centers are the components' least ids."""
    ends = e.select(F.col("hi").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("center")).union(e.select("lo", F.lit(0), F.lit(1)))
    odd = ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("center").alias("center")).where("leaf > 1 or (leaf = 1 and center = 1)")
    return not odd.limit(1).count()


def crc32_of_id(column: str = "doc_id") -> Column:
    """crc32 of an id's decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def on_rows(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow under a name that reads well at call sites."""
    return df.mapInArrow(fn, schema)
