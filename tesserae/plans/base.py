"""The table of registered queries, and inputs derived from the driver's tables.

Derived inputs are written once, as SQL expressions that both engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: An output with one or two labels, blanks and empty segments.
OUTPUT = """CASE doc_id % 6 WHEN 0 THEN source WHEN 1 THEN source || '|' || lang WHEN 2 THEN '|' || lang WHEN 3 THEN source || '|'
    WHEN 4 THEN ' ' || lang || ' | ' || source || ' ' ELSE '' END"""
RECORDS = f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS instruction, text AS input, {OUTPUT} AS output FROM documents"
#: Scores as text in all the forms that are read.
SCORE = """CASE event_id % 9 WHEN 0 THEN '0.' || lpad(CAST(event_id % 1000 AS VARCHAR(9)), 3, '0') WHEN 1 THEN CAST(event_id % 100 AS VARCHAR(9)) || '%'
    WHEN 2 THEN '"0.' || CAST(event_id % 10 AS VARCHAR(9)) || '"' WHEN 3 THEN '0.5 because' WHEN 4 THEN 'nan' WHEN 5 THEN '-0.' || CAST(event_id % 10 AS VARCHAR(9))
    WHEN 6 THEN '1_0' WHEN 7 THEN ' 1e-1 ' ELSE '0.03125' END"""
SCORED = f"SELECT event_id, {SCORE} AS output FROM events"
#: A number in [0, 1) with three decimals from an event.
UNIT = "(event_id * 7919) % 1000 / 1000.0D"
UNIT_SQL = "CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000"
LABELS = ("en", "de", "fr", "it")
PREDICTED = "SELECT doc_id, lang AS gold, CASE WHEN doc_id % 7 = 0 THEN 'en' WHEN doc_id % 11 = 0 THEN 'de' ELSE lang END AS predicted FROM documents"
STATUS = "CASE event_id % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'partial' WHEN 2 THEN 'error' ELSE 'pass' END"
#: Python's strip and the tagger's token in DuckDB.
STRIP_SQL = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
TOKEN_SQL = r"[\p{L}\p{N}_]+(?:[-./][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]"


def rows(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    """A derived input; `sql` selects from one table."""
    table(spark, sf_dir, name).createOrReplaceTempView(f"_{name}")
    return spark.sql(sql.replace(f"FROM {name}", f"FROM _{name}"))


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name, with the SQL that gives the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add
