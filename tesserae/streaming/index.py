"""Streaming twins: appending new files to an index."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery


def append_index(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """New Parquet files below source are appended to the index at target, each once."""
    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
