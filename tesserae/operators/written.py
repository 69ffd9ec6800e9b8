"""Tables written between steps: their lineage ends, so a lost executor costs one step."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder that all executors see (spark.checkpoint.dir); only where driver and executors are one process may it be
    missing, and a temporary folder takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[[^\[]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="tesserae-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again with the same columns."""
    path = f"{shared_folder(df.sparkSession)}/w-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's own settings while steps of a long job are written: shuffle files of a query go when it ends, not when the driver
#: collects its garbage; and Arrow batches of at most so many rows.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


@contextlib.contextmanager
def tidied(spark) -> Iterator[None]:
    """TIDY holds meanwhile, for queries that end within."""
    before = {name: spark.conf.get(name, None) for name in TIDY}
    try:
        for name, value in TIDY.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def deleted(spark, path: str) -> None:
    """Delete a folder in whatever store the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


@contextlib.contextmanager
def meanwhile(df: DataFrame) -> Iterator[DataFrame]:
    """df as a compressed table in the shared folder that is deleted afterwards."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/w-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        deleted(spark, path)


def hidden(columns: list[str], *names: str) -> list[str]:
    """Names for columns of our own that none of the given columns has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows and bytes of text that a Python task turns into its own objects at once; a longer text is a piece of its own.
PIECE_ROWS, PIECE_BYTES = 500, 1 << 20


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive rows of texts, each of bounded rows and bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    piece = size // PIECE_BYTES + np.arange(len(texts)) // PIECE_ROWS
    edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(texts)]
    yield from ((lo, hi) for lo, hi in zip(edges, edges[1:], strict=False) if hi > lo)
