"""Contrastive tuning of an encoder: a linear map over its vectors learns to put a query next to its own passage.

Each query of a batch has its own passage as the right answer and the other passages of the batch as wrong ones. The
map is as large as the vectors' dimension squared, whatever the number of pairs, so it goes to every task and a sum of
gradients comes back; the pairs stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.records import numbered

#: Tasks whose gradients one task of the tree adds up.
FAN_IN = 32


@dataclass(frozen=True)
class Tuning:
    """What a tuning run is given: `batch` pairs a batch, cosines times `scale`, the share of steps that warm up."""

    epochs: int = 3
    batch: int = 16
    steps_an_epoch: int = 8
    scale: float = 20.0
    rate: float = 0.02
    warmup: float = 0.1
    seed: int = 0


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.linalg.norm(x, axis=-1, keepdims=True) + 1e-12
    return x / length, length


def loss_and_gradient(w: np.ndarray, queries: np.ndarray, passages: np.ndarray, scale: float) -> tuple[float, np.ndarray]:
    """Mean cross-entropy of each query's own passage among the batch's, and its gradient by the map w.

    queries and passages are (batches, rows, dimension); the result sums over batches the means within each.
    """
    (q, q_length), (p, p_length) = _unit(queries @ w.T), _unit(passages @ w.T)
    logits = scale * q @ p.transpose(0, 2, 1)
    logits -= logits.max(axis=2, keepdims=True)
    share = np.exp(logits)
    share /= share.sum(axis=2, keepdims=True)
    own = np.arange(q.shape[1])
    loss = -np.log(share[:, own, own] + 1e-300).mean(axis=1).sum()
    error = share.copy()
    error[:, own, own] -= 1
    error *= scale / q.shape[1]
    dq, dp = error @ p, error.transpose(0, 2, 1) @ q
    dq = (dq - q * (dq * q).sum(-1, keepdims=True)) / q_length
    dp = (dp - p * (dp * p).sum(-1, keepdims=True)) / p_length
    return float(loss), np.einsum("bri,brj->ij", dq, queries) + np.einsum("bri,brj->ij", dp, passages)


def batched(pairs: DataFrame, size: int, epoch: int, seed: int) -> DataFrame:
    """(batch, q, p): pairs(pair_id, query_vector, passage_vector) in an order hashed from seed and epoch, `size` a batch.

    q and p hold the vectors of a batch one after the other. A last batch that is not full is left out, as other pairs
    will be in the next epoch; vectors that are null, or hold a null, are left out always.
    """
    whole = pairs.where("query_vector is not null and passage_vector is not null and not exists(query_vector, x -> x is null) and not exists(passage_vector, x -> x is null)")
    hashed = whole.select(F.xxhash64(F.lit(seed), F.lit(epoch), "pair_id").alias("place"), "query_vector", "passage_vector")
    rows = numbered(hashed, ["place"], "at").withColumn("batch", F.expr(f"(at - 1) div {size}"))
    by = rows.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("at", "query_vector", "passage_vector"))).alias("r"))
    vectors = lambda name: F.flatten(F.transform("r", lambda x: x[name])).cast("array<double>")
    return by.where(F.size("r") == size).select("batch", vectors("query_vector").alias("q"), vectors("passage_vector").alias("p"))


def _partial(w: np.ndarray, size: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, gradient, n = 0.0, np.zeros_like(w), 0
        for batch in batches:
            for rows in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                q, p = (rows.column(c).flatten().to_numpy().reshape(rows.num_rows, size, w.shape[1]) for c in ("q", "p"))
                part, g = loss_and_gradient(w, q, p, scale)
                loss, gradient, n = loss + part, gradient + g, n + rows.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "loss": [loss], "gradient": [gradient.ravel()]})

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, loss, gradient = 0, 0.0, None
    for batch in batches:
        for row in batch.to_pylist():
            n, loss, g = n + row["n"], loss + row["loss"], np.array(row["gradient"])
            gradient = g if gradient is None else gradient + g
    if n:
        yield pa.RecordBatch.from_pydict({"n": [n], "loss": [loss], "gradient": [gradient]})


SUMS = "n long, loss double, gradient array<double>"


def gradient_over(batches: DataFrame, w: np.ndarray, size: int, scale: float) -> tuple[float, np.ndarray, int]:
    """Mean loss over batches(q, p), its gradient and the number of batches; tasks' sums are added up in a tree."""
    sums = batches.select("q", "p").mapInArrow(_partial(w, size, scale), SUMS)
    tasks = batches.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        sums = sums.repartition(tasks).mapInArrow(_added, SUMS)
    parts = sums.collect()
    n = sum(r["n"] for r in parts)
    if not n:
        return 0.0, np.zeros_like(w), 0
    return sum(r["loss"] for r in parts) / n, sum(np.array(r["gradient"]) for r in parts).reshape(w.shape) / n, n


def tune(pairs: DataFrame, dimension: int, tuning: Tuning = Tuning()) -> tuple[np.ndarray, list[float]]:
    """The map learned from pairs(pair_id, query_vector, passage_vector), and the mean loss of each step.

    It starts as the identity, so an encoder is never worse for lack of pairs: fewer than a batch leave it as it is. Steps
    (each over its share of an epoch's batches) follow Adam under a rate that rises over the warm-up and then falls to 0.
    """
    w = np.eye(dimension)
    first, second = np.zeros_like(w), np.zeros_like(w)
    total, losses = tuning.epochs * tuning.steps_an_epoch, []
    warm = max(1, int(total * tuning.warmup))
    for epoch in range(tuning.epochs):
        rows = batched(pairs, tuning.batch, epoch, tuning.seed).persist()
        for step in range(tuning.steps_an_epoch):
            loss, gradient, n = gradient_over(rows.where(F.col("batch") % tuning.steps_an_epoch == step), w, tuning.batch, tuning.scale)
            if not n:
                continue
            at = len(losses) + 1
            rate = tuning.rate * (at / warm if at <= warm else max(0.0, (total - at + 1) / (total - warm + 1)))
            first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
            w = w - rate * (first / (1 - 0.9**at)) / (np.sqrt(second / (1 - 0.999**at)) + 1e-8)
            losses.append(loss)
        rows.unpersist()
    return w, losses


class Mapped:
    """An encoder followed by a learned map; vectors have length one."""

    def __init__(self, encoder, w: np.ndarray):
        self.encoder, self.w = encoder, w

    def encode(self, texts: list[str]) -> np.ndarray:
        return _unit(self.encoder.encode(texts) @ self.w.T)[0].astype(np.float32)


def mapped(df: DataFrame, w: np.ndarray, vector: str) -> DataFrame:
    """df with the map applied to a column of an encoder's vectors, as Mapped gives them for the texts."""

    @F.pandas_udf("array<float>")
    def run(c: pd.Series) -> pd.Series:
        return pd.Series(list(_unit(np.stack(c.to_numpy()) @ w.T)[0].astype(np.float32)) if len(c) else [])

    return df.withColumn(vector, run(vector))
