"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import Words, bloom, chunks, crc32_of_id, cut, discard, texts_of

#: Classes of bytes that are counted. Other bytes below 128 are symbols, those from 128 on letters.
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "line": b"\n", "stop": b".", "comma": b",;:", "mark": b"!?", "bar": b"|", "quote": b"'\"()-"}
SYMBOL, HIGH = len(CLASSES), len(CLASSES) + 1
CLASS_OF = np.full(256, SYMBOL, np.int64)
CLASS_OF[128:] = HIGH
for _i, _bytes in enumerate(CLASSES.values()):
    CLASS_OF[list(_bytes)] = _i
WIDTH = len(CLASSES) + 2
N_FEATURES = WIDTH + 11

#: Kernel width, number of features, ridge penalty a row, bins of the calibration, seed.
GAMMA, FOURIER, RIDGE, BINS, SEED = 0.05, 256, 1e-4, 2000, 20240501
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of document statistics for each text; an empty text has zeros."""
    n = len(texts)
    out = np.zeros((n, N_FEATURES))
    lengths = np.fromiter(map(len, texts), np.int64, n)
    blob = np.frombuffer(b"".join(texts), np.uint8)
    kind = CLASS_OF[blob]
    counts = np.bincount(np.repeat(np.arange(n), lengths) * WIDTH + kind, minlength=n * WIDTH).reshape(n, WIDTH)
    size = np.maximum(lengths, 1)
    out[:, :WIDTH] = counts / size[:, None]
    words = Words(texts)
    length = (words.end - words.start).astype(float)
    begin = CLASS_OF[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    last, first = begin[words.end - 1], begin[words.start]
    n_words = np.diff(words.first)
    has = n_words > 0
    of = np.repeat(np.arange(n), n_words)
    per = lambda x: np.bincount(of, x, n) / np.maximum(n_words, 1)
    same = np.zeros(len(length))
    if len(length) > 1:
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (of[1:] == of[:-1])
    alone = (first >= SYMBOL) & (first != HIGH) | (first == list(CLASSES).index("bar"))
    mean = per(length)
    extra = [np.log1p(n_words), mean, np.sqrt(np.maximum(per(length**2) - mean**2, 0)), per(same), per(last == SYMBOL), per(last == list(CLASSES).index("mark")), per(alone.astype(float)), per(first == list(CLASSES).index("upper"))]
    grams = words.grams(5)
    distinct, repeated = np.zeros(n), np.zeros(n)
    for i, (lo, hi) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        if hi > lo:
            distinct[i] = len(np.unique(words.hash[lo:hi])) / (hi - lo)
        if hi - lo > 5:
            repeated[i] = 1 - len(np.unique(grams[lo : hi - 4])) / (hi - lo - 4)
    capital = counts[:, 1] / np.maximum(counts[:, 0] + counts[:, 1], 1)
    out[:, WIDTH:] = np.stack([*extra, distinct, repeated, capital], axis=1)
    out[~has & (lengths == 0)] = 0
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a hundredth of it keeps the order of raw scores within a step."""
        raw = self.raw(x)
        return np.clip(0.99 * np.interp(raw, self.knots, self.values) + 0.01 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def fourier(x: np.ndarray) -> np.ndarray:
    """cos(xW + b) with W from a Gaussian: inner products approximate exp(-GAMMA |x - y|^2); and a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, np.sqrt(2 * GAMMA), (N_FEATURES, FOURIER))
    b = rng.uniform(0, 2 * np.pi, FOURIER)
    return np.hstack([np.sqrt(2 / FOURIER) * np.cos(np.clip(x, -8, 8) @ w + b), np.ones((len(x), 1))])


def isotonic(x: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over bins in ascending order: (mean position, mean value) of each pool."""
    pools: list[list[float]] = []
    for at, s, c in zip(x, total, count, strict=True):
        pools.append([at * c, s, c])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            for k, v in enumerate(pools.pop()):
                pools[-1][k] += v
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def measured(docs: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(doc_id, x): the statistics of every whole text; with among(doc_id), of the rows with these ids and a few others."""
    spark = docs.sparkSession
    wanted = None
    if among is not None:
        ids = cut(among.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct())
        wanted = spark.sparkContext.broadcast(bloom(ids, ids.count()))
        discard(ids)

    def run(batches):
        for batch in batches:
            if wanted is not None:
                keys = batch.column("doc_id")
                found = keys.is_valid().to_numpy(zero_copy_only=False) & wanted.value.has(np.asarray(keys.fill_null(0).to_numpy(zero_copy_only=False), np.int64))
                batch = batch.filter(pa.array(found))
            for part in chunks([batch], "text"):
                x = statistics(texts_of(part)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<float>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(float)


def fit(features: DataFrame, labels: DataFrame) -> Model | None:
    """The model from all labelled rows outside the held-out fold; None where there are none.

    Folds are crc32(doc_id as text) mod 5: 0 is held out, 4 calibrates, the rest fits the ridge scores. Means, normal
    equations and calibration bins are sums over partitions, of a size that does not depend on the rows.
    """
    fold = F.pmod(crc32_of_id(), F.lit(FOLDS))
    known = features.join(labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")), "doc_id")
    known = cut(known.withColumn("fold", fold).where(F.col("fold") != HELD_OUT))
    train, check = known.where(F.col("fold") != CALIBRATION), known.where(F.col("fold") == CALIBRATION)

    def sums(of, size):
        """Sums of a fixed-size vector over all rows, first in each partition, then in a few tasks, then here."""

        def part(batches):
            total = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    total += of(_matrix(batch), batch.column("y").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

        def add(batches):
            total = np.zeros(size)
            for batch in batches:
                for x in batch.column(0).to_pylist():
                    total += np.frombuffer(x)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

        found = train.select("x", "y").mapInArrow(part, "s binary").repartition(8).mapInArrow(add, "s binary")
        return sum((np.frombuffer(r["s"]) for r in found.collect()), np.zeros(size))

    k = N_FEATURES
    first = sums(lambda x, y: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]), 1 + 2 * k)
    n = first[0]
    if not n:
        return None
    mean = first[1 : 1 + k] / n
    scale = np.sqrt(np.maximum(first[1 + k :] / n - mean**2, 1e-8))
    d = FOURIER + 1

    def normal(x, y):
        z = fourier((x - mean) / scale)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    second = sums(normal, d * d + d)
    weights = np.linalg.solve(second[: d * d].reshape(d, d) + RIDGE * n * np.eye(d), second[d * d :])
    model = Model(mean, scale, weights, np.zeros(1), np.zeros(1))

    def binned(batches):
        for batch in batches:
            if batch.num_rows:
                at = np.clip(((model.raw(_matrix(batch)) + 1) / 3 * BINS).astype(np.int32), 0, BINS - 1)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column("y")], ["bin", "y"])

    bins = check.select("x", "y").mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("s"), F.count("*").alias("c")).orderBy("bin").collect()
    if not bins:
        bins = [(0, 0.0, 1), (BINS - 1, 1.0, 1)]
    at, s, c = (np.array(v, float) for v in zip(*bins, strict=True))
    model.knots, model.values = isotonic((at + 0.5) / BINS * 3 - 1, s, c)
    return model


def _scores(model: Model | None, x: np.ndarray) -> np.ndarray:
    return model.score(x) if model is not None else np.full(len(x), 0.5)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text), from statistics of the whole text alone.

    Null texts count as empty; without labelled rows to learn from every score is 0.5. held_out is
    crc32(doc_id as text) mod 5 = 0, false where doc_id is null.
    """
    features = cut(measured(docs))
    model = fit(features, labels)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(model, _matrix(batch)))], ["doc_id", "score"])

    held = F.coalesce(F.pmod(crc32_of_id(), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    return features.mapInArrow(run, "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least threshold.

    Null texts count as empty, repeated rows stay or go together, columns may have any names, and without labelled rows
    to learn from every row stays. The model learns from all labelled rows outside the held-out fold, of which the first
    scan measures the texts; the second scores every whole text and filters.
    """
    features = cut(measured(docs, labels.where("quality is not null")))
    model = fit(features, labels)
    discard(features)

    def run(batches):
        for batch in chunks(batches, "text"):
            good = _scores(model, statistics(texts_of(batch)).astype(np.float32).astype(float)) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
