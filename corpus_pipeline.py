"""A corpus pipeline of five stages, each applying one operator of tesserae.llm to all its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import cut, hidden, table
from tesserae.llm.mixing import mix_sources
from tesserae.llm.ngram_join import ngram_components
from tesserae.llm.packing import pack
from tesserae.llm.quality import keep_good
from tesserae.llm.suffix_dedup import remove_repeats

#: Files of the tokenizer that the last stage uses, and its limits on a sequence; a text's first 32 tokens bear no loss.
ENCODER = {
    "tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"),
    "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"),
    "pattern": public_tokenizers.PATTERN,
    "special": ("<|endoftext|>",),
}
LIMITS = {"tokens": 2048, "segments": 64, "loss": 2016, "prompt": 32}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at Jaccard 0.8 or more, the document with the smallest id stays.

    Of rows that repeat doc_id and text the least by the other columns (as JSON) stays, of unlike texts under one doc_id
    each; rows without doc_id link with nothing and stay. Columns may be of any name and type.
    """
    gone_id, rest_of = hidden(docs.columns, "gone", "rest")
    found = cut(ngram_components(docs, n=5, num=80, den=100))
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(gone_id)).distinct()
    kept = docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0).alias(gone_id)]
        single = kept.where("doc_id is not null").groupBy("doc_id", "text").agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})).alias(rest_of))
        kept = single.select("doc_id", "text", f"{rest_of}.*").select(*(f"`{c}`" for c in docs.columns)).union(kept.where("doc_id is null"))
    return kept


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the first document that holds them and leave the others' texts."""
    return remove_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh the square root of their sizes; documents repeat by Poisson numbers, rows without doc_id too.

    Columns of any name and type stay as they are; an empty table stays empty.
    """
    (copy,) = hidden(docs.columns, "copy")
    return mix_sources(docs, exponent=0.5, copy=copy).select(*(f"`{c}`" for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 2048, 64 pieces and 2016 tokens that bear loss."""
    return pack(docs, ENCODER, **LIMITS)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixing", mixing), ("packing", packing)]

#: Quality scores, suffix sorting and tokens are beyond SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
