"""Artifacts of a run: corpora, statistics, heads, scorecards, reports and indexes, as files below one root."""

from __future__ import annotations

import json

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import py_strip
from tesserae.operators.chunk import chunk_sections
from tesserae.operators.generate import Encoder, encode_texts
from tesserae.operators.records import output_stats
from tesserae.operators.reports import latest_checkpoint
from tesserae.sources.files import read_section_docs, write_index, write_jsonl


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file (a report, a head) in whatever store the path names."""
    target, fs = _hadoop(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is no such file."""
    target, fs = _hadoop(spark, path)
    if not fs.exists(target):
        return None
    return bytes(spark.read.format("binaryFile").load(path).first()["content"]).decode()


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2))


def read_json(spark: SparkSession, path: str):
    text = read_text(spark, path)
    return None if text is None else json.loads(text)


def write_output_stats(records: DataFrame, path: str) -> dict | None:
    """Token statistics of the outputs as a JSON file; none is written where every output is empty."""
    stats = output_stats(records).first()
    if not stats["sample_count"]:
        return None
    write_json(records.sparkSession, path, stats.asDict())
    return stats.asDict()


def write_head(spark: SparkSession, root: str, head: dict, metrics: dict) -> None:
    """A head with its labels and metrics, as three JSON files."""
    write_json(spark, f"{root}/head.json", head)
    write_json(spark, f"{root}/labels.json", {"labels": head.get("classes", [])})
    write_json(spark, f"{root}/metrics.json", metrics)


def write_sets(root: str, **sets: DataFrame) -> None:
    """Each set (train, eval, corpus) as JSON lines in a folder of its name."""
    for name, df in sets.items():
        write_jsonl(df, f"{root}/{name}.jsonl")


def save_scorecard(rows: DataFrame, root: str, stamp: str, baseline: bool = False) -> None:
    """Case rows as JSON lines under the stamp, and as what later runs compare with where baseline is set."""
    write_jsonl(rows, f"{root}/scorecard-{stamp}")
    if baseline:
        write_jsonl(rows, f"{root}/baseline")


def load_baseline(spark: SparkSession, root: str) -> DataFrame | None:
    target, fs = _hadoop(spark, f"{root}/baseline")
    return spark.read.json(f"{root}/baseline") if fs.exists(target) else None


def checkpoints(spark: SparkSession, root: str) -> DataFrame:
    """(path, step) of the checkpoint folder with the most steps below root."""
    target, fs = _hadoop(spark, root)
    found = [(s.getPath().toString(),) for s in fs.listStatus(target) if s.isDirectory()] if fs.exists(target) else []
    return latest_checkpoint(spark.createDataFrame(found, "path string"))


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """(step, loss, eval_loss) of a trainer's state file; a step has either."""
    state = spark.read.option("multiLine", True).schema("global_step long, log_history array<struct<step:long,loss:double,eval_loss:double>>").json(path)
    return state.select(F.explode("log_history").alias("e")).select("e.step", "e.loss", "e.eval_loss")


def index_chunks(chunks: DataFrame, encoder: Encoder, path: str, append: bool = False) -> None:
    """The chunks with their vectors as a Parquet index; without append it replaces what is there."""
    write_index(encode_texts(chunks, encoder), path, append)


def of_source(chunks: DataFrame, source: str | None) -> DataFrame:
    """The chunks of one named source, or all; where the table is partitioned by source, other folders are not read."""
    return chunks.where(F.col("source") == source) if source else chunks


def section_chunks_of(spark: SparkSession, root: str, source: str, **options) -> DataFrame:
    """(source, section, chunk_no, text): chunks of the section documents below root, named by their files till a heading."""
    docs = read_section_docs(spark, root).withColumn("source", F.lit(source))
    return chunk_sections(docs, ["source"], section="section", **options).withColumnRenamed("chunk", "text")


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """(instruction, input, output) of the JSON lines whose values all are strings; other lines are dropped.

    A value's own type is seen in a second reading as raw JSON: a string's text there begins with a quote.
    """
    lines = spark.read.text(path).where(F.length(py_strip(F.col("value"))) > 0)
    raw = F.from_json("value", "map<string,variant>", {"mode": "PERMISSIVE"})
    strings = F.forall(F.map_values("raw"), lambda v: F.schema_of_variant(v) == "STRING")
    rows = lines.withColumn("raw", raw).where(F.col("raw").isNotNull()).where(strings)
    return rows.select(*(F.get_json_object("value", f"$.{n}").alias(n) for n in ("instruction", "input", "output")))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The evaluation cases of a YAML list, with the columns that score_cases reads; what is not given is null."""
    names = {"id": "string", "topic": "string", "query": "string", "should_reject": "boolean", "expected_category": "string", "must_not_say": "array<string>", "should_abstain": "boolean", "config_is_valid": "boolean", "leading_premise": "boolean"}
    cases = yaml.safe_load(read_text(spark, path) or "[]") or []
    return spark.createDataFrame([tuple(c.get(n) for n in names) for c in cases], ", ".join(f"{n} {t}" for n, t in names.items()))


def load_config(spark: SparkSession, path: str) -> dict:
    """A YAML configuration as nested dicts; empty where the file is."""
    return yaml.safe_load(read_text(spark, path) or "") or {}


def render_report(title: str, tables: dict[str, DataFrame], shown: int = 15) -> str:
    """An HTML page with a table of the first `shown` rows of each DataFrame, everything escaped."""
    from html import escape

    parts = [f"<h1>{escape(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in row) + "</tr>" for row in df.limit(shown).collect())
        parts.append(f"<h2>{escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return f"<!doctype html><html><body>{''.join(parts)}</body></html>"
