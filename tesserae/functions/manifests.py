"""Column functions on manifests and questions about them: what is named, what is asked, what is wrong."""

from __future__ import annotations

import json
import re

import pandas as pd
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.text import py_strip, valid_name

#: Resource keywords in the order in which they are looked for, with API version, kind and whether the
#: kind is namespaced.
RESOURCES = (
    ("ec2nodeclass", "karpenter.k8s.aws/v1", "EC2NodeClass", False),
    ("nodepool", "karpenter.sh/v1", "NodePool", False),
    ("horizontalpodautoscaler", "autoscaling/v2", "HorizontalPodAutoscaler", True),
    ("scaledobject", "keda.sh/v1alpha1", "ScaledObject", True),
    ("poddisruptionbudget", "policy/v1", "PodDisruptionBudget", True),
    ("deployment", "apps/v1", "Deployment", True),
    ("hpa", "autoscaling/v2", "HorizontalPodAutoscaler", True),
    ("pdb", "policy/v1", "PodDisruptionBudget", True),
    ("node", "v1", "Node", False),
    ("pod", "v1", "Pod", True),
)
#: Signs of a symptom or of a question of cost.
OPERATIONAL = ("launch", "pending", "stuck", "fail", "event", "scal", "provision", "error", "crash", "evict", "terminat", "disrupt", "not work", "not com", "cost", "expensive", "bill", "spot", "saving", "price", "cheaper", "on-demand", "ondemand")
#: How a name and a namespace are given, in the order in which they are tried.
NAME_FORMS = (r"`([^`]+)`", r'"([^"]+)"', r"'([^']+)'", r"\bnamed\s+([a-z0-9][-a-z0-9.]*)", r"\bcalled\s+([a-z0-9][-a-z0-9.]*)")
NAMESPACE_FORMS = (r"-n\s+`?([a-z0-9][-a-z0-9.]*)", r"--namespace\s+`?([a-z0-9][-a-z0-9.]*)", r"namespace\s+[`'\"]?([a-z0-9][-a-z0-9.]*)", r"\bin\s+the\s+[`'\"]?([a-z0-9][-a-z0-9.]*)[`'\"]?\s+namespace")
#: Deprecated API versions and what replaces them.
DEPRECATED = {
    "autoscaling/v2beta1": "autoscaling/v2",
    "autoscaling/v2beta2": "autoscaling/v2",
    "karpenter.sh/v1alpha5": "karpenter.sh/v1",
    "karpenter.sh/v1beta1": "karpenter.sh/v1",
    "karpenter.k8s.aws/v1beta1": "karpenter.k8s.aws/v1",
    "policy/v1beta1": "policy/v1",
    "extensions/v1beta1": "apps/v1 (or networking.k8s.io/v1 for Ingress)",
}
FENCE = r"(?s)```(?:ya?ml)?\s*\n(.*?)```"
#: A line that a manifest can have: blank, indented, an item, or a key.
PART_OF_YAML = r"^(\s*$|[ \t]|- |[\w.\-/]+:(\s|$))"
SOUND = "No structural or deprecation issues found (client-side checks)."
FACTS = "struct<error:string,documents:array<struct<version:string,kind:string,name:string>>>"


def looks_like_yaml(c: Column) -> Column:
    """Whether a text holds a manifest: lines that give an apiVersion and a kind."""
    return c.rlike(r"(?m)^\s*apiVersion:\s*\S") & c.rlike(r"(?m)^\s*kind:\s*\S")


def split_documents(c: Column) -> Column:
    """The documents of a YAML text between lines of three hyphens, blank ones left out."""
    return F.filter(F.transform(F.split(c, r"(?m)^---[ \t]*$"), py_strip), lambda d: F.length(d) > 0)


def resource_ref(c: Column) -> Column:
    """(api_version, kind, namespaced) of the first resource keyword in the text, most specific first; else null."""
    kinds = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("keyword", "api_version", "kind", "namespaced"), r, strict=True))) for r in RESOURCES))
    found = F.get(F.filter(kinds, lambda r: F.contains(F.lower(c), r["keyword"])), F.lit(0))
    return F.when(found.isNotNull(), F.struct(found["api_version"].alias("api_version"), found["kind"].alias("kind"), found["namespaced"].alias("namespaced")))


def _first_valid(c: Column, forms: tuple[str, ...]) -> Column:
    """The first match of the first form whose first match is a valid name."""
    found = [F.regexp_extract(c, form, 1) for form in forms]
    return F.coalesce(*(F.when(valid_name(x), x) for x in found))


def extract_name(c: Column) -> Column:
    return _first_valid(c, NAME_FORMS)


def extract_namespace(c: Column) -> Column:
    return _first_valid(c, NAMESPACE_FORMS)


def is_operational(c: Column) -> Column:
    return F.lower(c).rlike("|".join(re.escape(w) for w in OPERATIONAL))


def route_tools(c: Column) -> Column:
    """The tools that a question calls for: a named resource is described, with its events on a symptom."""
    kind = resource_ref(c)["kind"]
    named = kind.isNotNull() & extract_name(c).isNotNull()
    tools = lambda *names: F.array(*map(F.lit, names))
    symptom = F.when(kind == "Pod", tools("describe_resource", "list_events")).otherwise(tools("describe_resource", "list_events", "investigate_cluster"))
    return F.when(~named, tools("investigate_cluster")).when(is_operational(c), symptom).otherwise(tools("describe_resource"))


def unhealthy(phase: Column, ready: Column) -> Column:
    """Whether a pod with this phase and readiness of its containers (array<boolean>) is a problem."""
    all_ready = (F.coalesce(F.size(ready), F.lit(0)) > 0) & F.coalesce(F.forall(ready, lambda r: r), F.lit(False))
    return (phase == "Pending") | ((phase == "Running") & ~all_ready)


def clause_tier(c: Column) -> Column:
    """How decisive a clause of a scheduler's message is: 0 for capacity, 2 for taints, 1 for the rest."""
    low = F.lower(c)
    return F.when(low.rlike("exceed|insufficient"), 0).when(F.contains(low, F.lit("did not tolerate taint")), 2).otherwise(1)


def prioritize_clauses(c: Column) -> Column:
    """The clauses of a scheduler's message, most decisive first and else in their order; a capacity clause is marked."""
    clauses = F.filter(F.transform(F.split(c, ";"), py_strip), lambda x: F.length(x) > 0)
    placed = F.array_sort(F.transform(clauses, lambda x, i: F.struct(clause_tier(x).alias("tier"), i.alias("at"), x.alias("text"))))
    ordered = F.transform(placed, lambda x: x["text"])
    rest = F.array_join(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), "; ")
    marked = F.concat(F.lit("PRIMARY BLOCKER: "), F.get(ordered, F.lit(0)), F.lit(" | other scheduler messages (informational only, often about other nodes/workloads on a shared cluster): "), rest)
    decisive = (F.size(ordered) > 1) & (F.get(placed, F.lit(0))["tier"] == 0)
    return F.when(F.size(clauses) == 0, c).when(decisive, marked).otherwise(F.array_join(ordered, "; "))


def _fenced(c: Column) -> Column:
    """The fenced blocks of a message that name both an apiVersion and a kind."""
    return F.filter(F.regexp_extract_all(c, F.lit(FENCE), F.lit(1)), lambda x: F.contains(x, F.lit("apiVersion")) & F.contains(x, F.lit("kind")))


def extract_manifest(c: Column) -> Column:
    """The manifest in a message: a fenced block that has both keys, else what follows an apiVersion line up to prose."""
    lines = F.transform(F.split(c, r"\r\n|\r|\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    at = lambda test: F.transform(F.filter(lines, lambda x: test(x["line"])), lambda x: x["at"])
    begin = F.array_min(at(lambda x: x.rlike(r"^\s*apiVersion:\s*\S")))
    end = F.array_max(at(lambda x: x.rlike(PART_OF_YAML)))
    tail = F.array_join(F.transform(F.filter(lines, lambda x: x["at"].between(begin, end)), lambda x: x["line"]), "\n")
    return py_strip(F.coalesce(F.get(_fenced(c), F.lit(0)), F.when(begin.isNull(), c).otherwise(tail)))


#: What the fast loader and Python's read alike: printable lines of keys, items and plain values, and empty brackets.
PLAIN_YAML = re.compile(r"(?:[A-Za-z0-9 \n:./_+=()~^$;\\-]|\{\}(?=\n|$)|\[\](?=\n|$))*")
FAST_LOADER = getattr(yaml, "CSafeLoader", None)


def _documents(text: str) -> list[dict]:
    """The mappings among a YAML text's documents; what the fast loader refuses or may read otherwise goes to Python's."""
    if FAST_LOADER and PLAIN_YAML.fullmatch(text):
        try:
            return [d for d in yaml.load_all(text, FAST_LOADER) if isinstance(d, dict)]
        except yaml.YAMLError:
            pass  # said in Python's words
    return [d for d in yaml.safe_load_all(text) if isinstance(d, dict)]


def _fact(text: str) -> tuple:
    """(error, [(version, kind, name)]) of a YAML text: what its documents say of themselves, empty values as null."""
    try:
        held = _documents(text)
    except yaml.YAMLError as e:
        return str(e), []
    named = [d["metadata"] if isinstance(d.get("metadata"), dict) else {} for d in held]
    return None, [tuple(str(x) if x else None for x in (d.get("apiVersion"), d.get("kind"), m.get("name"))) for d, m in zip(held, named, strict=True)]


def _findings(facts: Column) -> Column:
    """One line on the facts of a YAML text, by rules that each look at one document."""
    newer = F.create_map(*(F.lit(x) for pair in DEPRECATED.items() for x in pair))

    def rules(d: Column) -> Column:
        label = F.coalesce(d["kind"], F.lit("resource"))
        old = F.concat(label, F.lit(": apiVersion '"), d["version"], F.lit("' is deprecated; use '"), newer[d["version"]], F.lit("'"))
        missing = lambda field, said: F.when(d[field].isNull(), said)
        return F.array(missing("version", F.concat(label, F.lit(": missing apiVersion"))), missing("kind", F.lit("missing kind")), missing("name", F.concat(label, F.lit(": missing metadata.name"))), old)

    said = F.array_join(F.array_compact(F.flatten(F.transform(facts["documents"], rules))), "; ")
    return F.when(facts["error"].isNotNull(), F.concat(F.lit("Invalid YAML: "), facts["error"])).when(said == "", SOUND).otherwise(said)


def _told(c: pd.Series) -> pd.Series:
    """Facts of arrays of texts; texts that come again in a batch are read once."""
    told: dict[str, tuple] = {}

    def facts(texts) -> list[tuple]:
        held = [text or "" for text in texts]
        for text in held:
            if text not in told:
                told[text] = _fact(text)
        return [told[text] for text in held]

    return c.map(facts, na_action="ignore")


def _read(texts: Column) -> Column:
    @F.pandas_udf(f"array<{FACTS}>")
    def run(c: pd.Series) -> pd.Series:
        return _told(c)

    return run(texts)


def lint_manifest(c: Column) -> Column:
    """What is missing or deprecated in the manifests of a YAML text, in one line; null for null."""
    return F.when(c.isNotNull(), _findings(F.get(_read(F.array(c)), F.lit(0))))


def lint_draft(c: Column) -> Column:
    """The findings of every fenced manifest in a draft that has any."""
    return F.filter(F.transform(_read(_fenced(F.coalesce(c, F.lit("")))), _findings), lambda x: x != SOUND)


def pruned(value):
    """A JSON value without fields and items that are null or empty, at any depth."""
    if isinstance(value, dict):
        value = {k: pruned(v) for k, v in value.items()}
        return {k: v for k, v in value.items() if not _empty(v)}
    if isinstance(value, list):
        return [v for v in map(pruned, value) if not _empty(v)]
    return value


def _empty(value) -> bool:
    return value is None or (isinstance(value, dict | list | str) and not value)


def prune_json(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: json.dumps(pruned(json.loads(text)), ensure_ascii=False, separators=(",", ":")), na_action="ignore")

    return run(c)
