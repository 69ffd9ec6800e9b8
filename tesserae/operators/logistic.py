"""Multinomial logistic regression on sparse rows: partition sums of the loss and its gradient, L-BFGS over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Pairs of steps that L-BFGS remembers, tasks whose sums one task of the tree adds up.
MEMORY, FAN_IN = 10, 32
SUMS = "loss double, weight double, gradient binary"


def loss_and_gradient(w: np.ndarray, at: np.ndarray, value: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed weighted cross-entropy of rows and its gradient; w is (features + 1, classes), its last row the intercepts.

    Row i holds the features at[first[i] : first[i + 1]] with their values.
    """
    rows = np.repeat(np.arange(len(label)), np.diff(first))
    z = np.stack([np.bincount(rows, value * w[at, k], len(label)) for k in range(w.shape[1])], axis=1) + w[-1]
    z -= z.max(axis=1, keepdims=True)
    share = np.exp(z)
    total = share.sum(axis=1)
    mine = np.arange(len(label))
    loss = float((weight * (np.log(total) - z[mine, label])).sum())
    error = share / total[:, None]
    error[mine, label] -= 1
    error *= weight[:, None]
    gradient = np.stack([np.bincount(at, value * error[rows, k], len(w)) for k in range(w.shape[1])], axis=1)
    gradient[-1] += error.sum(axis=0)
    return loss, gradient


def _partial(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, weight, gradient = 0.0, 0.0, np.zeros_like(w)
        for batch in batches:
            if not batch.num_rows:
                continue
            at, value = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("at", "value"))
            first = np.concatenate([[0], np.cumsum(batch.column("at").value_lengths().to_numpy(zero_copy_only=False))])
            part, g = loss_and_gradient(w, at, value, first, batch.column("label").to_numpy(), batch.column("weight").to_numpy())
            loss, weight, gradient = loss + part, weight + float(batch.column("weight").to_numpy().sum()), gradient + g
        if weight:
            yield pa.RecordBatch.from_pydict({"loss": [loss], "weight": [weight], "gradient": [gradient.tobytes()]})

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    loss, weight, gradient = 0.0, 0.0, None
    for batch in batches:
        for row in batch.to_pylist():
            g = np.frombuffer(row["gradient"])
            loss, weight, gradient = loss + row["loss"], weight + row["weight"], g.copy() if gradient is None else gradient + g
    if weight:
        yield pa.RecordBatch.from_pydict({"loss": [loss], "weight": [weight], "gradient": [gradient.tobytes()]})


def mean_loss(rows: DataFrame, w: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Mean weighted loss over rows(at, value, label, weight) with `penalty` / 2 on the squared weights, and its gradient."""
    sums, tasks = rows.mapInArrow(_partial(w), SUMS), rows.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        sums = sums.repartition(tasks).mapInArrow(_added, SUMS)
    parts = sums.collect()
    weight = sum(r["weight"] for r in parts)
    held = np.vstack([w[:-1], np.zeros((1, w.shape[1]))])
    loss = sum(r["loss"] for r in parts) / weight + penalty / 2 * float((held**2).sum())
    return loss, sum(np.frombuffer(bytes(r["gradient"])) for r in parts).reshape(w.shape) / weight + penalty * held


def lbfgs(fn: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, most: int = 200, tolerance: float = 1e-7) -> np.ndarray:
    """The w that makes fn least, fn being convex and giving (value, gradient); steps halve until they descend enough."""
    value, gradient = fn(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(most):
        direction, used = gradient.copy(), []
        for s, y in reversed(steps):
            a = (s * direction).sum() / (s * y).sum()
            used.append(a)
            direction -= a * y
        if steps:
            s, y = steps[-1]
            direction *= (s * y).sum() / (y * y).sum()
        for (s, y), a in zip(steps, reversed(used), strict=True):
            direction += (a - (y * direction).sum() / (s * y).sum()) * s
        slope, size = -(direction * gradient).sum(), 1.0 if steps else min(1.0, 1 / (np.abs(gradient).sum() + 1e-12))
        while True:
            there = w - size * direction
            new, g = fn(there)
            if new <= value + 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        s, y = there - w, g - gradient
        done = abs(value - new) <= tolerance * max(1.0, abs(value)) or size < 1e-10
        w, value, gradient = there, new, g
        if done:
            break
        if (s * y).sum() > 1e-12:
            steps = [*steps, (s, y)][-MEMORY:]
    return w
