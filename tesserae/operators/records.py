"""Records (instruction, input, output): parsing, validation, splits, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.functions.text import py_strip
from tesserae.operators.written import hidden, written


def _once(c: Column, use) -> Column:
    """use(c), where c is worked out once however often use names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def unfenced(c: Column) -> Column:
    """What stands in a reply's first code fence, without the fence's language; the whole reply where it has none."""

    def body_of(inside: Column) -> Column:
        lines = F.contains(inside, F.lit("\n"))
        return F.when(inside.startswith("json") & lines, F.substring(inside, F.instr(inside, "\n") + 1, F.length(inside))).when(inside.startswith("json"), "").otherwise(inside)

    return _once(py_strip(c), lambda body: F.when(body.startswith("```"), _once(F.get(F.split(body, "```"), F.lit(1)), body_of)).otherwise(body))


def parse_responses(df: DataFrame, text: str = "response") -> DataFrame:
    """Lines of JSON in a generated text as records with line_no; input must not be empty, output not null.

    A text is cut, and each of its lines read, once: only what is a record becomes a row.
    """
    (found,) = hidden(df.columns, "found")
    lines = F.transform(F.split(unfenced(F.col(text)), r"\r\n|\r|\n"), lambda x, i: F.struct(i.alias("line_no"), py_strip(x).alias("line")))
    read = F.transform(F.filter(lines, lambda x: x["line"].startswith("{")), lambda x: F.struct(x["line_no"].alias("line_no"), F.from_json(x["line"], "instruction string, input string, output string").alias("r")))
    good = F.filter(read, lambda x: (F.length(x["r"]["input"]) > 0) & x["r"]["output"].isNotNull())
    kept = [c for c in df.columns if c != text]
    rows = df.select(*kept, F.explode_outer(good).alias(found)).where(F.col(found).isNotNull())
    fields = [py_strip(F.coalesce(F.col(f"{found}.r.{k}"), F.lit(""))).alias(k) for k in ("instruction", "input", "output")]
    return rows.select(*kept, F.col(f"{found}.line_no").alias("line_no"), *fields)


def parse_targets(df: DataFrame) -> DataFrame:
    """(text, y) of records for a regressor: the prompt, and the output as a number; rows without either go."""
    rows = df.select(prompt_text(F.col("instruction"), F.col("input")).alias("text"), T.py_float(F.col("output")).alias("y"), *(c for c in df.columns if c not in ("instruction", "input", "output")))
    return rows.where((F.length("text") > 0) & F.col("y").isNotNull())


def nonempty(df: DataFrame, column: str = "output") -> DataFrame:
    return df.where(F.length(T.py_strip(F.col(column))) > 0)


def prompt_text(instruction: Column, given: Column) -> Column:
    return F.when(F.length(instruction) > 0, F.concat(instruction, F.lit("\n\n"), given)).otherwise(given)


def validate_entities(df: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Rows whose output names entities of an allowed type that occur in the input; output is encoded anew."""
    found = F.filter(T.entities(F.col("output")), lambda e: (F.lit(True) if allowed is None else e["type"].isin(allowed)) & F.contains(F.col("input"), e["text"]))
    return df.withColumn("entities", found).where(F.size("entities") > 0).withColumn("output", T.encode_entities(F.col("entities"))).drop("entities")


def ungrounded(df: DataFrame, allow: list[str] | None = None) -> DataFrame:
    """df with `ungrounded`: identifiers of the output that neither the input nor the list has."""
    known = F.array_union(T.identifiers(F.col("input")), F.array(*(F.lit(a) for a in allow or [])).cast("array<string>"))
    return df.withColumn("ungrounded", F.array_except(T.identifiers(F.col("output")), known))


def ungrounded_rate(df: DataFrame) -> DataFrame:
    return ungrounded(df).agg(F.coalesce(F.avg((F.size("ungrounded") > 0).cast("double")), F.lit(0.0)).alias("rate"))


#: Rows of one range of a numbering.
RANGE_ROWS = 500_000


def numbered(df: DataFrame, order: list[str], name: str = "rn", parts: int | None = None) -> DataFrame:
    """A global 1-based row number in this order, in two passes and without gathering rows in one task.

    Rows are dealt to ranges of the order columns and of their place in the input, so that rows equal in all of these are
    split too; the sorted ranges are written once, counted, and numbered from the sums of the ranges before. There are
    as many ranges as the row count needs at RANGE_ROWS each, unless `parts` says so. Nulls come first; rows that are
    equal in the order columns keep an order of their own. An empty table stays empty.
    """
    place, part, own, size, before = hidden([*df.columns, name], "place", "part", "own", "size", "before")
    parts = parts or max(1, -(-df.count() // RANGE_ROWS))
    dealt = df.withColumn(place, F.monotonically_increasing_id()).repartitionByRange(parts, *order, place).sortWithinPartitions(*order, place)
    kept = written(dealt.drop(place).withColumn(part, F.spark_partition_id()).withColumn(own, F.monotonically_increasing_id() % (1 << 33) + 1))
    sizes = kept.groupBy(part).agg(F.count("*").alias(size))
    above = F.sum(size).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    starts = sizes.select(part, F.coalesce(above, F.lit(0)).alias(before))
    return kept.join(F.broadcast(starts), part).withColumn(name, F.col(own) + F.col(before)).drop(part, own, before)


def split_positional(df: DataFrame, order: list[str], ratio: float = 0.9) -> DataFrame:
    """df with `split`: the first floor(n * ratio) rows train, the rest eval; the last max(1, n // 10) if none is left."""
    n = df.count()
    cut = int(n * ratio)
    if cut >= n:
        cut = n - max(1, n // 10)
    (at,) = hidden([*df.columns, "split"], "at")
    return numbered(df, order, at).withColumn("split", F.when(F.col(at) <= cut, "train").otherwise("eval")).drop(at)


def plan_batches(spark, target: int, size: int = 5, abstain: float = 0.0) -> DataFrame:
    """(batch, n, abstain): ceil(target / size) batches, the last one partial; the first round(n * abstain) abstain."""
    count = -(-target // size)
    n = F.when(F.col("batch") == count - 1, F.lit(target - (count - 1) * size)).otherwise(F.lit(size))
    return spark.range(count).select(F.col("id").alias("batch"), n.cast("long").alias("n"), (F.col("id") < round(count * abstain)).alias("abstain"))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows chosen by a hash of the key: uniform, without replacement, the same on every run.

    Each task keeps its n rows of least hash, of which the n least of all remain.
    """
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)


def output_stats(df: DataFrame) -> DataFrame:
    """Token statistics of non-empty outputs: a token is four characters; p95 is the value at index floor(0.95 n)."""
    tokens = nonempty(df).select(F.floor(F.length("output") / 4).alias("t"))
    by = tokens.groupBy("t").agg(F.count("*").alias("c"))
    upto = by.withColumn("upto", F.sum("c").over(Window.orderBy("t")))  # distinct lengths only
    total = by.agg(F.sum("c").alias("n"))
    rank = F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)
    return upto.crossJoin(F.broadcast(total)).agg(
        F.max("t").alias("max_output_tokens"),
        F.bround(F.sum(F.col("t") * F.col("c")) / F.max("n")).cast("long").alias("avg_output_tokens"),
        F.min(F.when(F.col("upto") > rank, F.col("t"))).alias("p95_output_tokens"),
        F.coalesce(F.max("n"), F.lit(0)).alias("sample_count"),
    )


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in this order."""
    (place,) = hidden(df.columns, "place")
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) == 1).drop(place)


def last_rows(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    (place,) = hidden(df.columns, "place")
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where(F.col(place) <= n).drop(place)
