"""Readers and writers: whole files, JSON lines, HTML text, event streams, indexes."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import py_strip


def read_raw(spark: SparkSession, root: str, sources: list[str]) -> DataFrame:
    """(source, content) of every non-empty file below the prefixes; bytes that are not UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load([f"{root}/{s}" for s in sources])

    @F.pandas_udf("string")
    def decode(c: pd.Series) -> pd.Series:
        return c.map(lambda b: bytes(b).decode("utf-8", "replace").strip())

    return files.select(F.col("path").alias("source"), decode("content").alias("content")).where("content <> ''")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_grounding_corpus(spark: SparkSession, root: str, least: int = 80) -> DataFrame:
    rows = spark.read.schema("text string, source string, section string").option("pathGlobFilter", "*.jsonl").option("mode", "DROPMALFORMED").json(root)
    return rows.where(F.length(py_strip(F.col("text"))) >= least)


def read_section_docs(spark: SparkSession, root: str) -> DataFrame:
    """(section, text) of .md and .adoc files whose names do not start with _index."""
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    return files.where(F.col("name").rlike(r"\.(md|adoc)$") & ~F.col("name").startswith("_index")).select(F.regexp_replace("name", r"\.md$", "").alias("section"), F.col("value").alias("text"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_index(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").parquet(path)


def export_corpus(df: DataFrame, path: str) -> None:
    write_jsonl(df.where(F.length(py_strip(F.col("text"))) > 0).select("text", "source", "section"), path)


class _Text(HTMLParser):
    #: Elements whose text is left out, and those whose text is wanted, in order of preference.
    SKIPPED = {"nav", "footer", "aside", "header", "script", "style"}
    WANTED = ("main", "article", "body")

    def __init__(self):
        super().__init__()
        self.skip, self.open, self.parts = 0, [], {k: [] for k in (*self.WANTED, "")}

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIPPED
        if tag in self.WANTED:
            self.open.append(tag)

    def handle_endtag(self, tag):
        self.skip -= tag in self.SKIPPED and self.skip > 0
        if tag in self.open:
            self.open.remove(tag)

    def handle_data(self, data):
        if not self.skip and data.strip():
            for tag in {*self.open, ""}:
                self.parts[tag].append(data.strip())


def page_text(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    return "\n".join(next((parser.parts[t] for t in (*_Text.WANTED, "") if parser.parts[t]), []))


def html_to_text(df: DataFrame, html: str = "html", least: int = 0) -> DataFrame:
    @F.pandas_udf("string")
    def convert(c: pd.Series) -> pd.Series:
        return c.map(page_text)

    return df.withColumn("text", convert(html)).where(F.length("text") >= least)


def read_sse(df: DataFrame, line: str = "value") -> DataFrame:
    """Events of `data: ` lines; the end mark is an event of type done, bad JSON goes."""
    rows = df.where(F.col(line).startswith("data: ")).withColumn("_d", F.substring(line, 7, 1 << 30))
    event = F.from_json("_d", "type string, text string, name string, detail string, ms double, reason string, note string")
    rows = rows.withColumn("_e", F.when(F.col("_d") == "[DONE]", F.struct(F.lit("done").alias("type"), *(F.lit(None).cast(t).alias(n) for n, t in (("text", "string"), ("name", "string"), ("detail", "string"), ("ms", "double"), ("reason", "string"), ("note", "string"))))).otherwise(event))
    return rows.where("_e.type is not null").select(*(c for c in df.columns if c != line), "_e.*")
