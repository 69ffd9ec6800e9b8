"""Column functions that read the replies of models: judge lines, verdicts, categories, logs of training."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.text import ordered_distinct, py_strip, segments

#: Words of an off-topic reply, and marks of a training log's lines.
OFF_TOPIC = ("not relate", "unrelated", "off-topic", "noise")
PROGRESS_MARKS = ("Exporting to GGUF", "GGUF export complete", "Training complete", "Upload complete")
#: Most characters of a reason that is kept.
REASON_CHARS = 160


def first_line(c: Column) -> Column:
    return py_strip(F.substring_index(py_strip(c), "\n", 1))


def judge_line(c: Column) -> Column:
    """(correct, reasoning) of a reply like `CORRECT: why`; without a colon a rejection's line is its own reasoning."""
    line = first_line(c)
    correct, colon = F.upper(line).startswith("CORRECT"), F.instr(line, ":")
    after = py_strip(F.substring(line, colon + 1, F.length(line)))
    return F.struct(correct.alias("correct"), F.when(colon > 0, after).when(correct, "").otherwise(line).alias("reasoning"))


def gate_verdict(draft: Column, reply: Column) -> Column:
    """(escalate, reason) of a gate's reply; an empty draft, no reply and an unreadable one escalate."""
    found = F.lower(F.regexp_extract(reply, r'"verdict"\s*:\s*"(\w+)"', 1))
    reason = F.substring(F.regexp_extract(reply, r'"reason"\s*:\s*"([^"]*)"', 1), 1, REASON_CHARS)
    empty = F.length(py_strip(F.coalesce(draft, F.lit("")))) == 0
    return F.struct(
        (empty | (F.coalesce(found, F.lit("")) != "pass")).alias("escalate"),
        F.when(empty, "empty draft").when(reply.isNull(), "gate error").otherwise(reason).alias("reason"),
    )


JUDGEMENT = "verdict string, reason string, abstained boolean, invented_problem boolean, followed_wrong_premise boolean, hallucinated boolean"


def judgement(reply: Column) -> Column:
    """The outermost JSON object of a judge's reply as JUDGEMENT; one that cannot be read is a failure that says so."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    read = F.from_json(body, JUDGEMENT + ", broken string", {"columnNameOfCorruptRecord": "broken"})
    shown = F.substring(reply, 1, 120)
    why = F.when(body == "", F.concat(F.lit("unparseable judge output: "), shown)).when(read["broken"].isNotNull(), F.concat(F.lit("bad judge json: "), shown))
    failure = F.struct(F.lit("fail").alias("verdict"), why.alias("reason"), *(F.lit(None).cast("boolean").alias(n) for n in ("abstained", "invented_problem", "followed_wrong_premise", "hallucinated")))
    good = F.struct(*(read[n].alias(n) for n in ("verdict", "reason", "abstained", "invented_problem", "followed_wrong_premise", "hallucinated")))
    return F.when(why.isNotNull(), failure).otherwise(good)


def category_reply(c: Column, categories: list[str], confidences: list[str] = ("high", "medium", "low")) -> Column:
    """(category, confidence) of a reply like `a|high`: of the first line's segments the last that is known counts.

    Where none is a category, the first of the list that the whole reply contains is; a reply that says it is off topic
    is noise with high confidence; else both are unknown.
    """
    low = F.lower(c)
    parts = segments(F.lower(F.substring_index(c, "\n", 1)))
    last = lambda known: F.try_element_at(F.filter(parts, lambda x: x.isin(list(known))), F.lit(-1))
    inside = F.get(F.filter(F.array(*map(F.lit, categories)), lambda k: F.contains(low, k)), F.lit(0))
    off = F.exists(F.array(*map(F.lit, OFF_TOPIC)), lambda w: F.contains(low, w))
    said = F.coalesce(last(categories), inside)
    return F.struct(
        F.coalesce(said, F.when(off, "noise"), F.lit("unknown")).alias("category"),
        F.coalesce(F.when(said.isNull() & off, "high"), last(confidences), F.lit("unknown")).alias("confidence"),
    )


def entity_types(fields: Column) -> Column:
    """The distinct names over all fields' value lists (array<array<string>>) in order of first appearance."""
    return ordered_distinct(F.flatten(fields))


def progress(log: Column) -> Column:
    """What a training log says: its settings, its last progress line and its last loss, else its last three lines.

    Carriage returns end lines too. Settings and progress are the last lines of their kind; a loss line is JSON.
    """
    lines = F.transform(F.split(log, r"\r|\n"), py_strip)
    last = lambda test: F.try_element_at(F.filter(lines, test), F.lit(-1))
    bar = lambda x: F.contains(x, F.lit("/")) & F.contains(x, F.lit("|")) & F.contains(x, F.lit("%"))
    moved = last(lambda x: bar(x) | F.exists(F.array(*map(F.lit, PROGRESS_MARKS)), lambda m: F.contains(x, m)))
    settings = last(lambda x: F.contains(x, F.lit("Num examples")) & F.contains(x, F.lit("Total steps")))
    record = F.from_json(last(lambda x: x.startswith('{"loss"')), "loss double, epoch double")
    loss = F.when(record["loss"].isNotNull(), F.format_string("Loss: %.4f (epoch %.1f)", record["loss"], F.coalesce(record["epoch"], F.lit(0.0))))
    said = F.array_compact(F.array(settings, moved, loss))
    full = F.filter(lines, lambda x: F.length(x) > 0)
    tail = F.slice(full, F.greatest(F.size(full) - 2, F.lit(1)), F.lit(3))
    return F.array_join(F.when(F.size(said) > 0, said).otherwise(tail), "\n")


def report_colour(percent: Column) -> Column:
    return F.when(percent >= 80, "green").when(percent >= 50, "yellow").otherwise("red")
