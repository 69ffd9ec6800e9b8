"""Sizes of training and serving by a model, its quantisation and its data; validation of a configuration."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import model_size

#: By the most billions of parameters: CPUs and threads, memory by quantisation (q4 and q5, q8_0, none),
#: steps between checkpoints, memory and disk of the conversion.
SIZES = (
    (3, "4", "6Gi", "6Gi", "12Gi", 500, "16Gi", "40Gi"),
    (5, "4", "8Gi", "10Gi", "16Gi", 250, "24Gi", "48Gi"),
    (8, "8", "16Gi", "16Gi", "24Gi", 100, "40Gi", "64Gi"),
    (None, "16", "24Gi", "28Gi", "40Gi", 50, "56Gi", "72Gi"),
)
FIELDS = ("cpu", "memory", "memory_q8", "memory_f16", "checkpoint_steps", "convert_memory", "convert_disk")
#: Samples below which more epochs are run, epochs, and what stands for unknown numbers of samples.
FEW_SAMPLES, EPOCHS, SAMPLES_A_PAIR, DEFAULT_SAMPLES = 10_000, (5, 3), 3, 5_000
ENCODER_TASKS = ("classification", "scoring", "extraction", "embedding")


def sample_count(pairs: Column) -> Column:
    return F.when(pairs > 0, pairs * SAMPLES_A_PAIR).otherwise(DEFAULT_SAMPLES)


def auto_size(configs: DataFrame) -> DataFrame:
    """configs(task, base, quantize, pairs, epochs) with the sizes of each; 0 or null pairs and epochs are not given.

    Tasks with an encoder have one small size. For generation the model's size picks a row of SIZES, the quantisation its
    memory, the number of samples the epochs; epochs that are given take precedence, and six or more wait longer.
    """
    encoder = F.col("task").isin(*ENCODER_TASKS)
    size = model_size(F.col("base"))
    kinds = F.coalesce(F.when(F.col("quantize") != "", F.col("quantize")), F.lit("q4_k_m"))
    row = F.lit(None)
    for most, *values in reversed(SIZES):
        named = F.struct(*(F.lit(v).alias(n) for n, v in zip(FIELDS, values, strict=True)))
        row = named if most is None else F.when(size <= most, named).otherwise(row)
    given = F.coalesce("epochs", F.lit(0))
    chosen = F.when(sample_count(F.coalesce("pairs", F.lit(0))) < FEW_SAMPLES, EPOCHS[0]).otherwise(EPOCHS[1])
    rows = configs.withColumn("r", row).withColumn("size", F.when(~encoder, size))
    memory = F.when(kinds.isin("none", "f16"), F.col("r.memory_f16")).when(kinds == "q8_0", F.col("r.memory_q8")).otherwise(F.col("r.memory"))
    return rows.select(
        *configs.columns,
        F.when(encoder, "2").otherwise(F.col("r.cpu")).alias("cpu"),
        F.when(encoder, "4Gi").otherwise(memory).alias("memory"),
        F.when(encoder, "2").otherwise(F.col("r.cpu")).alias("threads"),
        F.when(~encoder, F.col("r.checkpoint_steps")).alias("checkpoint_steps"),
        F.when(~encoder, F.col("r.convert_memory")).alias("convert_memory"),
        F.when(~encoder, F.col("r.convert_disk")).alias("convert_disk"),
        F.when(given > 0, given).when(encoder, 1).otherwise(chosen).cast("int").alias("sized_epochs"),
        F.when(~encoder, F.when(given >= 6, 4).otherwise(2)).alias("patience"),
        F.when(~encoder, F.when(F.col("size") <= 7, 2e-4).otherwise(1e-4)).alias("learning_rate"),
    )


def concurrency(rpm: Column) -> Column:
    """Calls at once under a quota a minute: 80 % of what three-second calls would use, 5 to 20; 20 without a quota."""
    return F.when(rpm > 0, F.greatest(F.lit(5), F.least(F.lit(20), F.floor(rpm * 0.8 * 3 / 60)))).otherwise(20).cast("int")


# ---------------------------------------------------------------- configurations

#: Tasks, values of single fields, and patterns of names that go into paths.
TASKS = ("generation", "classification", "scoring", "extraction", "reranking", "embedding")
NOT_BUILT = ("reranking",)
HEAD_TASKS, LABEL_TASKS = ("classification", "scoring", "extraction"), ("classification", "extraction")
CHOICES = {
    "project.output_format": ("free_form",),
    "model.quantize": ("q4_k_m", "q5_k_m", "q8_0", "f16", "none"),
    "model.head": ("logistic", "linear", "mlp"),
}
SAFE_NAME, SAFE_BUCKET, UNSAFE_PATH = r"[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?", r"[a-z0-9][a-z0-9.\-]{1,61}[a-z0-9]", r"(^|/)\.\.(/|$)"
LEAST_PAIRS, MOST_EPOCHS = 10, 20


def _value(config: dict, path: str):
    for part in path.split("."):
        config = config.get(part) if isinstance(config, dict) else None
    return config


def validate_config(config: dict) -> list[tuple[str, str]]:
    """(field, message) of everything that is wrong with a configuration; empty where it is valid."""
    get = lambda path: _value(config, path)
    found: list[tuple[str, str]] = []

    def need(ok, field: str, message: str) -> None:
        if not ok:
            found.append((field, message))

    task = get("project.task")
    for field in ("project.name", "project.domain", "project.task", "data.bucket", "data.path"):
        need(get(field), field, "is required")
    for field, allowed in CHOICES.items():
        need(not get(field) or get(field) in allowed, field, f"must be one of {', '.join(allowed)}")
    need(not task or task in TASKS, "project.task", f"must be one of {', '.join(TASKS)}")
    need(task not in NOT_BUILT, "project.task", f"task {task} is not supported")
    if epochs := get("training.epochs"):
        need(1 <= epochs <= MOST_EPOCHS, "training.epochs", f"must be from 1 to {MOST_EPOCHS}")
    for block in ("data.synthetic", "data.evaluation"):
        if given := get(block):
            need(given.get("model"), f"{block}.model", "is required")
            need((given.get("pairs") or 0) >= LEAST_PAIRS, f"{block}.pairs", f"must be {LEAST_PAIRS} at least")
    for i, source in enumerate(get("data.sources") or []):
        need(source.get("path"), f"data.sources[{i}].path", "is required")
    if task and task != "extraction":
        need(get("model.base"), "model.base", "is required for this task")
    learns, head = task in (*HEAD_TASKS, "embedding"), task in HEAD_TASKS
    if learns:
        need(get("data.synthetic"), "data.synthetic", f"task {task} requires it")
        need(not get("project.output_format"), "project.output_format", "applies to generation only")
        need(not get("model.quantize"), "model.quantize", "applies to generation only")
    if task in LABEL_TASKS:
        need(get("project.labels"), "project.labels", f"task {task} requires a taxonomy")
    if task == "embedding":
        need(not get("project.labels"), "project.labels", "do not apply to embedding")
        need(get("data.sources"), "data.sources", "embedding requires a source")
    if not head:
        need(not get("model.head"), "model.head", "applies to tasks with a head only")
    for field, pattern in (("project.name", SAFE_NAME), ("data.bucket", SAFE_BUCKET)):
        need(not get(field) or re.fullmatch(pattern, get(field)), field, "is not a safe name")
    need(not re.search(UNSAFE_PATH, get("data.path") or ""), "data.path", "must not climb out of its folder")
    return found
