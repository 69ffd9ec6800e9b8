"""Embedding near-duplicates by an exact metric range join over pivot cells."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import components, cut, discard

#: Most pivots of a label, vectors of a label that they are chosen from (by a hash of vec_id, so at random), and bytes of
#: pivots that go to all tasks; labels beyond that have one cell. Labels of fewer than SMALL vectors need no pivots.
PIVOTS, SAMPLE, PIVOT_BYTES, SMALL = 256, 4000, 64 << 20, 16
#: Vectors that one task compares with as many others, and rows of them at a time.
BLOCK, STRIP = 8192, 128
#: More than rounding can add to an angle or a projection.
SLACK = 1e-7


def unit(batch: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension, (rows, unit vectors) of the usable vectors: not null, not zero, all components finite."""
    found = {}
    values = batch.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = np.asarray(batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    for dim in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == dim)
        x = values[begin[rows][:, None] + np.arange(dim)]
        largest = np.abs(x).max(axis=1)
        ok = np.isfinite(x).all(axis=1) & (largest > 0)
        rows, x = rows[ok], x[ok] / largest[ok, None]
        found[int(dim)] = rows, x / np.sqrt((x * x).sum(axis=1))[:, None]
    return found


def choose_pivots(vectors: np.ndarray, k: int) -> np.ndarray:
    """Farthest-first: each pivot is the sample's vector farthest from those before."""
    chosen = [0]
    nearest = vectors @ vectors[0]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    return vectors[chosen]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (the least number of each component) once the components of a[i] and b[i] are one."""
    pairs = np.unique(np.stack([label[a], label[b]], axis=1), axis=0)
    a, b = pairs[pairs[:, 0] != pairs[:, 1]].T
    while (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
    return label


def _links(cosine: float):
    """For applyInArrow on a block pair: link counts, and a spanning forest of the links, never all pairs."""

    def run(rows: pa.Table) -> pa.Table:
        ids, weight = rows.column("vec_id").to_numpy(), rows.column("copies").to_numpy()
        home, block = rows.column("home").to_numpy(zero_copy_only=False), rows.column("block").to_numpy()
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        x = np.frombuffer(b"".join(rows.column("unit").to_pylist())).reshape(len(ids), -1)
        left = np.flatnonzero(home & (block == i))
        right = left if i == j else np.flatnonzero(home & (block == j)) if j >= 0 else np.flatnonzero(~home)
        count, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        other = x[right].T
        for lo in range(0, len(left), STRIP):
            part = left[lo : lo + STRIP]
            near = x[part] @ other >= cosine
            if i == j:
                near[np.arange(len(part)), lo + np.arange(len(part))] = False
            if not near.any():
                continue
            count[part] += near @ weight[right]
            if i != j:
                count[right] += weight[part] @ near
            a, b = np.nonzero(near)
            label = _merge(label, part[a], right[b])
        some = np.flatnonzero(count)
        return pa.table({"vec_id": ids[some], "n": count[some], "root": ids[label[some]]}, schema=pa.schema([("vec_id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())]))

    return run


def pivot_count(n: int, most: int) -> int:
    """Pivots of a label of n vectors: an eighth of the square root, two at least."""
    return min(most, max(2, math.ceil(math.sqrt(n) / 8)))


def _pivots(classes: DataFrame, most: int, kind: str) -> dict[tuple, np.ndarray]:
    """By (label, dim): farthest-first pivots of labels of SMALL vectors or more, pivot_count of them.

    Labels with the most vectors come first, until PIVOT_BYTES are used.
    """
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") >= SMALL)
    wanted, used = [], 0
    for r in sizes.orderBy(F.desc("n"), "label", "dim").toLocalIterator():
        k = pivot_count(r["n"], most)
        used += k * r["dim"] * 8
        if used > PIVOT_BYTES:
            break
        wanted.append((r["label"], r["dim"], k, r["n"]))
    if not wanted:
        return {}
    chosen = classes.sparkSession.createDataFrame(wanted, f"label {kind}, dim int, k int, n long")
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    drawn = classes.join(F.broadcast(chosen), ["label", "dim"]).where(place.cast("double") * F.col("n") < float(2 * SAMPLE << 30))  # some 2 SAMPLE of each label
    order = F.row_number().over(Window.partitionBy("label", "dim").orderBy(place, "vec_id"))
    sample = drawn.select("label", "dim", "k", "unit", order.alias("at")).where(F.col("at") <= SAMPLE)

    def choose(rows: pa.Table) -> pa.Table:
        dim, k = rows.column("dim")[0].as_py(), rows.column("k")[0].as_py()
        x = np.frombuffer(b"".join(rows.sort_by("at").column("unit").to_pylist())).reshape(-1, dim)
        return pa.table({"label": rows.column("label").slice(0, 1), "dim": rows.column("dim").slice(0, 1), "set": pa.array([choose_pivots(x, k).tobytes()], pa.binary())})

    found = sample.groupBy("label", "dim").applyInArrow(choose, f"label {kind}, dim int, set binary")
    return {(r["label"], r["dim"]): np.frombuffer(bytes(r["set"])).reshape(-1, r["dim"]) for r in found.toLocalIterator()}


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label).

    Two vectors link where their labels are equal and not null, their dimensions are equal and the cosine of their
    doubles is at least `cosine`. Vectors that are null, zero or hold null or non-finite components link with nothing:
    n_links 0, component_id their own. Rows without vec_id do too, with a null component_id. Rows that repeat a vec_id
    count as vectors of their own in n_links and each get a row. Other columns are left out.

    Null, empty, repeated and clashing columns change nothing else, and an empty table gives an empty one. The label may
    be of any type that has an equality.

    Equal vectors are one class. On the sphere the angle is a metric: a class lies in the cell of its nearest pivot of its
    label, and is replicated to each cell of a lower number that can hold a vector within r (r = acos(cosine)): by the
    triangle inequality its pivot is at most 2 r farther, and x is within r of the half of the sphere that is nearer to
    it. So each pair meets in one cell, and cells join independently, in blocks of bounded size that give link counts and
    spanning links. Pivots are farthest-first from a sample of SAMPLE vectors of a label, two or more of each label of SMALL
    vectors (see pivot_count) and `pivots` at most; any choice leaves the result exact.
    """
    base = vectors.select(F.col("vec_id").cast("long"), "embedding", "label")
    kind = base.schema["label"].dataType.simpleString()
    dims = f"vec_id long, label {kind}, unit binary, dim int"

    def units(batches):
        for batch in batches:
            for dim, (rows, x) in unit(batch.column("embedding")).items():
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(np.full(len(rows), dim, np.int32))], ["vec_id", "label", "unit", "dim"])

    whole = F.forall("embedding", lambda v: v.isNotNull()) & (F.size("embedding") > 0)
    usable = base.where("vec_id is not null and label is not null and embedding is not null").where(whole).mapInArrow(units, dims)
    usable = cut(usable)
    classes = usable.groupBy("label", "dim", "unit").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    classes = cut(classes)
    sets = vectors.sparkSession.sparkContext.broadcast(_pivots(classes, pivots, kind))
    angle_of = float(np.arccos(np.clip(cosine, -1.0, 1.0)))
    reach, beyond = 2 * angle_of + SLACK, (np.sin(angle_of) if cosine > 0 else 2.0) + SLACK

    def place(batches):
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
            units_ = batch.column("unit").to_pylist()
            by: dict = {}
            for row, key in enumerate(keys):
                by.setdefault(key if key in sets.value else None, []).append(row)
            for key, of in by.items():
                rows = np.array(of)
                if key is None:
                    row, to, cell = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                else:
                    p = sets.value[key]
                    dots = np.frombuffer(b"".join(units_[r] for r in of)).reshape(len(of), -1) @ p.T
                    cell = dots.argmax(axis=1)
                    angle = np.arccos(np.clip(dots, -1, 1))
                    near = angle <= angle[np.arange(len(of)), cell][:, None] + reach
                    apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 1e-30))
                    near &= (dots[np.arange(len(of)), cell][:, None] - dots) <= beyond * apart[cell]
                    near &= np.arange(len(p)) < cell[:, None]
                    near[np.arange(len(of)), cell] = True
                    row, to = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows[row])) for c in ("vec_id", "label", "dim", "unit", "copies")), pa.array(to.astype(np.int32)), pa.array(to == cell[row])], ["vec_id", "label", "dim", "unit", "copies", "cell", "home"])

    placed = cut(classes.select("vec_id", "label", "dim", "unit", "copies").mapInArrow(place, f"vec_id long, label {kind}, dim int, unit binary, copies long, cell int, home boolean"))
    cell = ["label", "dim", "cell"]
    blocks = placed.groupBy(*cell).agg(F.ceil(F.sum(F.col("home").cast("long")) / block).cast("int").alias("homes"), F.ceil(F.sum((~F.col("home")).cast("long")) / block).cast("int").alias("guests"))
    rows = placed.join(blocks.where("homes > 0"), cell)
    mine = F.pmod(F.xxhash64("vec_id"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    rows = rows.withColumn("block", mine)
    each = F.sequence(F.lit(0), F.col("homes") - 1)
    pairs = F.when(
        F.col("home"),
        F.concat(
            F.transform(each, lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"))),
            F.when(F.col("guests") > 0, F.transform(F.sequence(F.lit(1), F.greatest("guests", F.lit(1))), lambda g: F.struct(F.col("block").alias("i"), (-g).alias("j")))).otherwise(F.expr("cast(array() as array<struct<i:int,j:int>>)")),
        ),
    ).otherwise(F.transform(each, lambda o: F.struct(o.alias("i"), (-F.col("block") - 1).alias("j"))))
    tasks = rows.withColumn("t", F.explode(pairs)).select(*cell, "t.i", "t.j", "vec_id", "copies", "unit", "home", "block")
    found = cut(tasks.groupBy(*cell, "i", "j").applyInArrow(_links(cosine), "vec_id long, n long, root long"))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    label = components(found.where("vec_id <> root").select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    discard(placed)
    per_class = classes.join(counts, "vec_id", "left").join(label.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    per_class = per_class.select("label", "dim", "unit", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    linked = usable.join(per_class, ["label", "dim", "unit"]).select("vec_id", "n_links", "component_id")
    bad_ids = _unusable(base)
    return linked.union(bad_ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _unusable(base: DataFrame) -> DataFrame:
    """vec_id of the rows that link with nothing."""
    real = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", real) & F.exists("embedding", lambda v: v != 0)
    return base.where(~F.coalesce(usable, F.lit(False))).select("vec_id")
