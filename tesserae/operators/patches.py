"""Bounded patches: what may be changed, whether a proposal is valid, the smallest patch, and whether it took effect."""

from __future__ import annotations

import json
import re
from fractions import Fraction
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import py_strip, quantity

#: The fields that may be changed, by kind and path: verb, least, most and allowed values.
FIELDS = (
    ("NodePool", "spec.limits.cpu", "set_quantity", "1", None, None),
    ("NodePool", "spec.limits.memory", "set_quantity", "4Gi", None, None),
    ("NodePool", "capacity_type", "add_to_set", None, None, ["spot", "on-demand", "reserved"]),
    ("Deployment", "spec.template.spec.nodeSelector", "remove_unschedulable_nodeselector_keys", None, None, None),
    ("Deployment", "spec.replicas", "set_int", "0", "50", None),
)
SCHEMA = "kind string, field string, verb string, least string, most string, allowed array<string>"
#: Where the set that a capacity type is added to lies.
SET_AT = {"list": "spec.template.spec.requirements", "match": "key", "is": "karpenter.sh/capacity-type", "target": "values"}


def patch_schema(spark) -> DataFrame:
    return spark.createDataFrame(list(FIELDS), SCHEMA)


def validate_patch(proposals: DataFrame, schema: DataFrame) -> DataFrame:
    """proposals(kind, field, value) with ok, normal (the value as it is set) and error."""
    rows = proposals.join(F.broadcast(schema), ["kind", "field"], "left")
    value = py_strip(F.col("value"))
    amount, whole = quantity(value), F.when(value.rlike(r"^[+-]?\d+$"), value.try_cast("long"))
    number = F.when(F.col("verb") == "set_int", whole.cast("double")).otherwise(amount)
    below, above = number < quantity(F.col("least")), number > quantity(F.col("most"))
    scalar = F.col("verb").isin("set_quantity", "set_int")
    error = (
        F.when(F.col("verb").isNull(), F.concat(F.col("field"), F.lit(" is not an allowed field for "), F.col("kind")))
        .when(scalar & number.isNull(), F.when(F.col("verb") == "set_int", "not a valid integer").otherwise("not a valid quantity"))
        .when(scalar & F.coalesce(below, F.lit(False)), F.concat(F.lit("must be >= "), F.col("least")))
        .when(scalar & F.coalesce(above, F.lit(False)), F.concat(F.lit("must be <= "), F.col("most")))
        .when((F.col("verb") == "add_to_set") & ~F.array_contains("allowed", F.col("value")), F.concat(F.lit("must be one of "), F.array_join("allowed", ", ")))
    )
    normal = F.when(F.col("verb") == "set_int", whole.cast("string")).when(F.col("verb") == "set_quantity", value).otherwise(F.col("value"))
    return rows.select(*proposals.columns, error.isNull().alias("ok"), F.when(error.isNull(), normal).alias("normal"), error.alias("error"))


def unschedulable_keys(selectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, key) of selectors(name, selector map) for the keys that no label of nodes(labels map) has."""
    wanted = selectors.select("name", F.explode(F.map_keys("selector")).alias("key"))
    there = nodes.select(F.explode(F.map_keys("labels")).alias("key")).distinct()
    return wanted.join(there, "key", "left_anti").select("name", "key")


def with_member(values, member):
    """A sorted set with one more member, as an expression over an array column."""
    return F.array_sort(F.array_union(F.coalesce(values, F.expr("cast(array() as array<string>)")), F.array(member)))


#: What a quantity's suffix multiplies by: fixed values of the notation.
SUFFIXES = {"": 1, "n": Fraction(1, 10**9), "u": Fraction(1, 10**6), "m": Fraction(1, 1000)} | {s: 1000 ** (i + 1) for i, s in enumerate("kMGTPE")} | {f"{s}i": 1024 ** (i + 1) for i, s in enumerate("KMGTPE")}
AMOUNT = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+))(?:[eE]([+-]?\d+))?(Ki|Mi|Gi|Ti|Pi|Ei|[numkMGTPE]?)\s*")


def amount(value) -> Fraction | None:
    """The exact number that a quantity stands for: 1000m is 1, 1Gi is 1024Mi; None for what is none."""
    found = AMOUNT.fullmatch(str(value)) if isinstance(value, str | int | float) and not isinstance(value, bool) else None
    return Fraction(found[1]) * Fraction(10) ** int(found[2] or 0) * SUFFIXES[found[3]] if found else None


class Field:
    """A field of a resource as a list of keys: reads it, and gives the merge patch that sets it."""

    def __init__(self, path: str):
        self.keys = path.split(".")

    def read(self, tree):
        return reduce(lambda t, k: t.get(k) if isinstance(t, dict) else None, self.keys, tree)

    def patch(self, value) -> dict:
        return reduce(lambda inner, k: {k: inner}, reversed(self.keys), value)


def _set(kind):
    """A verb that sets a value of this kind, and holds where the value there is of equal worth."""
    return (lambda tree, field, value, keys: field.patch(kind(value))), (lambda tree, field, value, keys: (w := worth(kind, value)) is not None and worth(kind, field.read(tree)) == w)


def worth(kind, value):
    if kind is str:
        return amount(value)
    return int(value) if isinstance(value, int | str) and not isinstance(value, bool) and re.fullmatch(r"\s*[+-]?\d+\s*", str(value)) else None


def _entries(tree, matching_only: bool = False) -> list:
    held = Field(SET_AT["list"]).read(tree) or []
    return [e for e in held if isinstance(e, dict) and e.get(SET_AT["match"]) == SET_AT["is"]] if matching_only else held


def _with(entry, value):
    if not isinstance(entry, dict) or entry.get(SET_AT["match"]) != SET_AT["is"]:
        return entry
    return entry | {SET_AT["target"]: sorted({*(entry.get(SET_AT["target"]) or ()), value})}


def _add(tree, field, value, keys):
    sets = [e.get(SET_AT["target"]) or () for e in _entries(tree, True)]
    if not sets or any(value in held for held in sets):
        return None
    return Field(SET_AT["list"]).patch([_with(e, value) for e in _entries(tree)])


def _has(tree, field, value, keys):
    return any(value in (e.get(SET_AT["target"]) or ()) for e in _entries(tree, True)[:1])


def _unknown(tree, field, keys) -> list[str]:
    return sorted(k for k in field.read(tree) or () if k not in keys)


#: What each verb of the schema plans on a resource, and whether a resource shows it.
VERBS = {
    "set_quantity": _set(str),
    "set_int": _set(int),
    "add_to_set": (_add, _has),
    "remove_unschedulable_nodeselector_keys": (
        lambda tree, field, value, keys: field.patch(dict.fromkeys(gone)) if (gone := _unknown(tree, field, keys)) else None,
        lambda tree, field, value, keys: not _unknown(tree, field, keys),
    ),
}


def plan(current: dict, field: str, verb: str, value, node_keys: set[str] = frozenset()) -> dict | None:
    """The smallest merge patch that applies a valid proposal; None where nothing is to be done."""
    return VERBS[verb][0](current, Field(field), value, node_keys)


def merged(tree, patch):
    """A JSON merge patch applied: nulls remove, objects merge, all else replaces."""
    if not isinstance(patch, dict):
        return patch
    out = dict(tree) if isinstance(tree, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merged(out.get(k), v)
    return out


def verified(after: dict, field: str, verb: str, value, node_keys: set[str] = frozenset()) -> bool:
    """Whether a resource shows the proposal; quantities count by their worth, however they are written."""
    return bool(VERBS[verb][1](after, Field(field), value, node_keys))


def apply_patches(df: DataFrame) -> DataFrame:
    """df(resource JSON, field, verb, normal, node_keys) with patch (JSON or null), after (JSON) and verified."""

    @F.pandas_udf("struct<patch:string,after:string,verified:boolean>")
    def run(resource: pd.Series, field: pd.Series, verb: pd.Series, value: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out = []
        for tree, f, v, x, k in zip(map(json.loads, resource), field, verb, value, keys, strict=True):
            known = set(k) if k is not None else set()
            patch = plan(tree, f, v, x, known)
            after = merged(tree, patch) if patch else tree
            out.append((json.dumps(patch) if patch else None, json.dumps(after), verified(after, f, v, x, known)))
        return pd.DataFrame(out, columns=["patch", "after", "verified"])

    return df.withColumn("p", run("resource", "field", "verb", "normal", "node_keys")).select("*", "p.*").drop("p")


def shown(df: DataFrame) -> DataFrame:
    """df(resource JSON, field, verb, normal, node_keys) with verified: whether the resource shows the proposal."""

    @F.pandas_udf("boolean")
    def run(resource: pd.Series, field: pd.Series, verb: pd.Series, value: pd.Series, keys: pd.Series) -> pd.Series:
        each = zip(map(json.loads, resource), field, verb, value, keys, strict=True)
        return pd.Series([verified(tree, f, v, x, set(k) if k is not None else set()) for tree, f, v, x, k in each])

    return df.withColumn("verified", run("resource", "field", "verb", "normal", "node_keys"))
