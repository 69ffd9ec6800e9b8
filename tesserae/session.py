"""Session factory and table access shared by every module."""

from __future__ import annotations

import os

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

#: Settings for one machine only. On a cluster partitions, memory and the rest are the cluster's own.
LOCAL = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}


def get_spark(app: str = "tesserae", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC, with AQE and ANSI left at their defaults.

    The master is the one given, else what spark-submit or SPARK_MASTER names, else all cores of this machine; only a
    local one gets LOCAL.
    """
    chosen = master or SparkConf().get("spark.master", None) or os.environ.get("SPARK_MASTER", "local[*]")
    settings = {"spark.sql.session.timeZone": "UTC"} | (LOCAL if chosen.startswith("local") else {}) | conf
    builder = SparkSession.builder.appName(app).master(chosen)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
