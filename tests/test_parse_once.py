"""Replies are cut and read once, with the same records; white space is Python's."""

import json
import sys

from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.operators import records


def test_white_space_is_that_of_python(spark):
    assert set(text.SPACES) == {chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()}
    raw = [None, "", "a", text.SPACES, text.SPACES + "a" + text.SPACES + "b" + text.SPACES, "​a​", "  é\U0001f600 \n"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string").select("i", text.py_strip(F.col("t")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in got} == {i: t.strip() if t is not None else None for i, t in enumerate(raw)}


def test_each_line_is_parsed_once(spark):
    """The plan reads JSON in one place; columns of any name go along."""
    line = json.dumps({"instruction": " i ", "input": " x ", "output": " y "})
    raw = [None, "", f"```json\n{line}\n```{line}", f"```json{line}", f"a\r{line}\r\n {line} \n{{bad\n[1]", '{"input":"","output":"x"}\n{"input":"x"}\n{"input":{"a":1},"output":[2]}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "found int, response string")
    out = records.parse_responses(df)
    assert out.columns == ["found", "line_no", "instruction", "input", "output"]
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(2, 0, "i", "x", "y"), (4, 1, "i", "x", "y"), (4, 2, "i", "x", "y"), (5, 2, "", '{"a":1}', "[2]")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("btrim") + plan.count("trim(") <= 8
