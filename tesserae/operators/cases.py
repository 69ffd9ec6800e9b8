"""Scorecards of evaluation cases: checks, statuses, repeated runs, what a set of statuses means for an exit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.profile import majority_status
from tesserae.operators.scorecard import forbidden, status

#: Fixed value: what an answer says that rejects a question.
REJECTION = "does not look like"


def triage_ok(should_reject: Column, expected: Column, triage: Column, answer: Column) -> Column:
    """A case to reject was rejected; any other was given its expected category, if it has one."""
    low = F.lower(F.coalesce(triage, F.lit("")))
    rejected = F.contains(low, F.lit("reject")) | F.contains(F.lower(answer), F.lit(REJECTION))
    wanted = F.lower(F.coalesce(expected, F.lit("")))
    return F.when(F.coalesce(should_reject, F.lit(False)), rejected).otherwise((wanted == "") | F.contains(low, wanted))


def miscalibrated(df_case: dict[str, Column], judge: dict[str, Column]) -> Column:
    """Whether the answer should have abstained, found a problem that is not there, or followed a wrong premise."""
    said = lambda c: F.coalesce(c, F.lit(False))
    pairs = (
        (df_case["should_abstain"], ~said(judge["abstained"])),
        (df_case["config_is_valid"], said(judge["invented_problem"])),
        (df_case["leading_premise"], said(judge["followed_wrong_premise"])),
    )
    out = F.lit(False)
    for asked, wrong in pairs:
        out = out | (said(asked) & wrong)
    return out


def score_cases(df: DataFrame) -> DataFrame:
    """df with status, violations and checks of rows with a case's columns, answer, triage and judge (a JUDGEMENT).

    A case's columns: should_reject, expected_category, must_not_say (array), should_abstain, config_is_valid,
    leading_premise; any may be null. Cases to reject pass by their triage alone.
    """
    judge = {n: F.col(f"judge.{n}") for n in ("verdict", "abstained", "invented_problem", "followed_wrong_premise", "hallucinated")}
    case = {n: F.col(n) for n in ("should_abstain", "config_is_valid", "leading_premise")}
    to_reject = F.coalesce(F.col("should_reject"), F.lit(False))
    triage = triage_ok(F.col("should_reject"), F.col("expected_category"), F.col("triage"), F.col("answer"))
    violations = forbidden(F.col("answer"), F.coalesce("must_not_say", F.expr("cast(array() as array<string>)")))
    verdict = F.coalesce(judge["verdict"], F.lit("fail"))
    off, invented = miscalibrated(case, judge), F.coalesce(judge["hallucinated"], F.lit(False))
    scored = status((F.size("violations") > 0) | off | (verdict == "fail"), (verdict == "partial") | invented)
    rows = df.withColumn("violations", violations)
    checks = F.struct(
        triage.alias("triage"), (F.size("violations") == 0).alias("must_not_say"), F.when(~to_reject, ~off).alias("calibration"),
        F.when(~to_reject, verdict == "pass").alias("correctness"), F.when(~to_reject, ~invented).alias("not_hallucinated"),
    )
    return rows.withColumn("status", F.when(to_reject, F.when(triage, "pass").otherwise("fail")).otherwise(scored)).withColumn("checks", checks)


def only(cases: DataFrame, ids: str, key: str = "id") -> DataFrame:
    """The cases of a comma-separated list of ids; all where it is blank."""
    wanted = [x.strip() for x in ids.split(",") if x.strip()]
    return cases.where(F.col(key).isin(wanted)) if wanted else cases


def repeated(runs: DataFrame, key: str, order: str) -> DataFrame:
    """(key, status, runs, pass_rate, seconds) of runs(key, order, status or null, seconds); a run without status is an error.

    The most frequent status counts, of equally frequent ones the worst.
    """
    known = runs.withColumn("status", F.coalesce("status", F.lit("error")))
    voted = majority_status(known, key, "status").select(key, "status")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, "status"))), lambda x: x["status"])
    passed = F.concat(F.count_if(F.col("status") == "pass").cast("string"), F.lit("/"), F.count("*").cast("string"))
    detail = known.groupBy(key).agg(listed.alias("runs"), passed.alias("pass_rate"), F.bround(F.sum("seconds"), 1).alias("seconds"))
    return voted.join(detail, key)


def totals(rows: DataFrame) -> DataFrame:
    """(pass, partial, fail, error, n, failed) of case rows; failed says whether a process should end as failed."""
    count = lambda s: F.count_if(F.col("status") == s)
    return rows.agg(*(count(s).alias(s) for s in ("pass", "partial", "fail", "error")), F.count("*").alias("n"), ((count("fail") + count("error")) > 0).alias("failed"))


def relayed(tokens: DataFrame, run: str, step: str, seq: str, text: str, ms: str) -> DataFrame:
    """The events of token streams: one of type step_done with the time of each step's first token before its tokens."""
    first = F.row_number().over(Window.partitionBy(run, step).orderBy(seq))
    rows = tokens.withColumn("nth", first)
    timing = rows.where("nth = 1").select(run, step, F.col(seq), F.lit(0).alias("part"), F.lit("step_done").alias("type"), F.lit("time to first token").alias("text"), F.col(ms).alias("ms"))
    return timing.unionByName(rows.select(run, step, F.col(seq), F.lit(1).alias("part"), F.lit("token").alias("type"), F.col(text).alias("text"), F.lit(None).cast("double").alias("ms")))
