"""Registered queries over replies, questions, manifests and patches, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import manifests as M
from tesserae.functions import replies as R
from tesserae.functions import text as T
from tesserae.operators import generate, patches, records
from tesserae.plans.base import SCORED, STRIP_SQL, query, rows
from tesserae.session import table

QUERY_REPLY = """SELECT event_id, 'ask:' || chr(10) || '{"query":" ' || event_type || ' ' || CAST(user_id AS VARCHAR(9)) || '?"}' || chr(10) || '{"query":""}' || chr(10) || '{bad' || chr(10)
    || ' {"q":1}' || chr(10) || ' {"query":"' || event_type || '"} ' AS response FROM events"""


@query("s06_parse_queries", f"""
    WITH u AS (SELECT event_id, unnest(string_split(response, chr(10))) AS line, CAST(generate_subscripts(string_split(response, chr(10)), 1) - 1 AS INTEGER) AS line_no FROM ({QUERY_REPLY})),
    j AS (SELECT event_id, line_no, CASE WHEN json_valid(line) THEN trim(json_extract_string(line, '$.query')) END AS query FROM u WHERE starts_with(trim(line), '{{'))
    SELECT event_id, line_no, query FROM j WHERE length(query) > 0""")
def s06(spark, sf_dir):
    return generate.parse_queries(rows(spark, sf_dir, "events", QUERY_REPLY))


_NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@query("p09_parse_targets", rf"""
    WITH t AS (SELECT event_id, trim(output) AS o FROM ({SCORED}))
    SELECT event_id, 'i' || chr(10) || chr(10) || 'x' AS text, CAST(CASE WHEN regexp_matches(o, '{_NUMBER}') THEN CAST(replace(o, '_', '') AS DOUBLE) ELSE 'nan' END AS DOUBLE) AS y
    FROM t WHERE regexp_matches(o, '{_NUMBER}') OR o = 'nan'""")
def p09(spark, sf_dir):
    return records.parse_targets(rows(spark, sf_dir, "events", SCORED).withColumns({"instruction": F.lit("i"), "input": F.lit("x")}))


@query("p17_report_colour", "SELECT event_id, CASE WHEN value >= 80 THEN 'green' WHEN value >= 50 THEN 'yellow' ELSE 'red' END AS colour FROM events")
def p17(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", R.report_colour(F.col("value")).alias("colour"))


PODS = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Succeeded' ELSE 'Running' END AS phase, event_id % 5 AS n, event_id % 3 = 0 AS r FROM events"""


@query("p23_unhealthy", f"SELECT event_id FROM ({PODS}) WHERE phase = 'Pending' OR (phase = 'Running' AND (n = 0 OR NOT r))")
def p23(spark, sf_dir):
    pods = rows(spark, sf_dir, "events", PODS)
    ready = F.slice(F.array(F.lit(True), F.col("r"), F.lit(True), F.lit(True)), F.lit(1), F.when(F.col("n") == 0, 0).otherwise(F.lit(4)))
    return pods.where(M.unhealthy(F.col("phase"), ready)).select("event_id")


CATEGORIES = ("multi", "noise", "single")
TRIAGE = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'Single | HIGH' WHEN 1 THEN 'multi|single|low' || chr(10) || 'noise' WHEN 2 THEN 'I think a single one' WHEN 3 THEN 'this is unrelated'
    WHEN 4 THEN 'hm|medium' WHEN 5 THEN event_type || '|noise' WHEN 6 THEN 'off-topic | low' ELSE event_type END AS reply FROM events"""


@query("p32_category_reply", f"""
    WITH s AS (SELECT event_id, lower(reply) AS low, list_transform(string_split(lower(string_split(reply, chr(10))[1]), '|'), lambda x: trim(x)) AS parts FROM ({TRIAGE})),
    f AS (SELECT event_id, low, list_filter(parts, lambda x: x IN {CATEGORIES})[-1] AS c, list_filter(parts, lambda x: x IN ('high', 'medium', 'low'))[-1] AS k,
        list_filter({list(CATEGORIES)}, lambda x: contains(low, x))[1] AS inside, len(list_filter({list(R.OFF_TOPIC)}, lambda x: contains(low, x))) > 0 AS off FROM s)
    SELECT event_id, coalesce(c, inside, CASE WHEN off THEN 'noise' END, 'unknown') AS category, CASE WHEN c IS NULL AND inside IS NULL AND off THEN 'high' ELSE coalesce(k, 'unknown') END AS confidence FROM f""")
def p32(spark, sf_dir):
    said = R.category_reply(F.col("reply"), list(CATEGORIES))
    return rows(spark, sf_dir, "events", TRIAGE).select("event_id", said.alias("s")).select("event_id", "s.*")


JUDGED = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'CORRECT: it is ' || event_type || ': yes' WHEN 1 THEN ' incorrect : no' || chr(10) || 'CORRECT: x' WHEN 2 THEN 'Correct' WHEN 3 THEN 'no idea' ELSE '' END AS reply FROM events"""


@query("p33_judge_line", f"""
    WITH l AS (SELECT event_id, trim(string_split({STRIP_SQL.format('reply')}, chr(10))[1]) AS line FROM ({JUDGED}))
    SELECT event_id, starts_with(upper(line), 'CORRECT') AS correct, CASE WHEN instr(line, ':') > 0 THEN trim(substring(line, instr(line, ':') + 1)) WHEN starts_with(upper(line), 'CORRECT') THEN '' ELSE line END AS reasoning FROM l""")
def p33(spark, sf_dir):
    return rows(spark, sf_dir, "events", JUDGED).select("event_id", R.judge_line(F.col("reply")).alias("s")).select("event_id", "s.*")


GATED = """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN ' ' ELSE event_type END AS draft, CASE event_id % 5 WHEN 0 THEN '{"verdict": "PASS", "reason": "' || event_type || '"}'
    WHEN 1 THEN 'so {"verdict" : "escalate","reason":"' || repeat('long ', 50) || '"} ok' WHEN 2 THEN '{"verdict": pass}' WHEN 3 THEN '"verdict":"pass"' ELSE NULL END AS reply FROM events"""


@query("p35_gate_verdict", rf"""
    WITH v AS (SELECT event_id, trim(draft) = '' AS empty, reply, lower(regexp_extract(reply, '"verdict"\s*:\s*"(\w+)"', 1)) AS verdict, regexp_extract(reply, '"reason"\s*:\s*"([^"]*)"', 1) AS why FROM ({GATED}))
    SELECT event_id, empty OR coalesce(verdict, '') <> 'pass' AS escalate, CASE WHEN empty THEN 'empty draft' WHEN reply IS NULL THEN 'gate error' ELSE substring(why, 1, 160) END AS reason FROM v""")
def p35(spark, sf_dir):
    return rows(spark, sf_dir, "events", GATED).select("event_id", R.gate_verdict(F.col("draft"), F.col("reply")).alias("s")).select("event_id", "s.*")


JUDGEMENTS = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Sure: {"verdict":"partial","reason":"' || event_type || '","abstained":true,"hallucinated":false}' WHEN 1 THEN 'none'
    WHEN 2 THEN '{"verdict":"pass",' || chr(10) || '"invented_problem":true}' ELSE '{"verdict":' || event_type || '}' END AS reply FROM events"""


@query("p35_judgement", rf"""
    WITH b AS (SELECT event_id, reply, regexp_extract(reply, '(?s)\{{.*\}}', 0) AS body FROM ({JUDGEMENTS})), j AS (SELECT *, json_valid(body) AND body <> '' AS good FROM b)
    SELECT event_id, CASE WHEN good THEN json_extract_string(body, '$.verdict') ELSE 'fail' END AS verdict,
        CASE WHEN body = '' THEN 'unparseable judge output: ' || substring(reply, 1, 120) WHEN NOT good THEN 'bad judge json: ' || substring(reply, 1, 120) ELSE json_extract_string(body, '$.reason') END AS reason,
        CASE WHEN good THEN CAST(json_extract_string(body, '$.abstained') AS BOOLEAN) END AS abstained, CASE WHEN good THEN CAST(json_extract_string(body, '$.invented_problem') AS BOOLEAN) END AS invented_problem FROM j""")
def p35_judgement(spark, sf_dir):
    said = rows(spark, sf_dir, "events", JUDGEMENTS).select("event_id", R.judgement(F.col("reply")).alias("s"))
    return said.select("event_id", "s.verdict", "s.reason", "s.abstained", "s.invented_problem")


@query("p39_entity_types", "SELECT doc_id, array_to_string(CASE WHEN source = lang THEN [source] ELSE [lang, source] END, ',') AS types FROM documents")
def p39(spark, sf_dir):
    fields = F.array(F.array("lang", F.lit(" ")), F.array(F.concat(F.lit(" "), F.col("source")), "lang", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(R.entity_types(fields), ",").alias("types"))


LOG = """SELECT event_id, 'start' || chr(10) || CASE WHEN event_id % 2 = 0 THEN ' Num examples = ' || CAST(user_id AS VARCHAR(9)) || ' | Total steps = 5 ' || chr(10) ELSE '' END
    || CASE WHEN event_id % 3 = 0 THEN '1%| | 1/5' || chr(13) || '20%|# | 2/5 ' || chr(13) ELSE '' END || CASE WHEN event_id % 5 = 0 THEN '{"loss": 1.25, "epoch": 0.5}' || chr(10) ELSE '' END
    || CASE WHEN event_id % 7 = 0 THEN 'Training complete' ELSE event_type END || chr(10) || '   ' || chr(10) AS log FROM events"""


@query("p41_progress", rf"""
    WITH l AS (SELECT event_id, list_transform(string_split(replace(log, chr(13), chr(10)), chr(10)), lambda x: trim(x)) AS l FROM ({LOG})),
    f AS (SELECT event_id, list_filter(l, lambda x: length(x) > 0) AS filled, list_filter(l, lambda x: contains(x, 'Num examples') AND contains(x, 'Total steps'))[-1] AS a,
        list_filter(l, lambda x: (contains(x, '/') AND contains(x, '|') AND contains(x, '%')) OR contains(x, 'Training complete'))[-1] AS b, list_filter(l, lambda x: starts_with(x, '{{"loss"'))[-1] AS j FROM l),
    s AS (SELECT event_id, filled, list_filter([a, b, CASE WHEN j IS NOT NULL THEN printf('Loss: %.4f (epoch %.1f)', CAST(json_extract(j, '$.loss') AS DOUBLE), CAST(json_extract(j, '$.epoch') AS DOUBLE)) END], lambda x: x IS NOT NULL) AS said FROM f)
    SELECT event_id, array_to_string(CASE WHEN len(said) > 0 THEN said ELSE filled[-3:] END, chr(10)) AS progress FROM s""")
def p41(spark, sf_dir):
    return rows(spark, sf_dir, "events", LOG).select("event_id", R.progress(F.col("log")).alias("progress"))


@query("f14_label_display", "SELECT event_id, array_to_string(list_transform(string_split(replace(event_type || '_OF_' || event_type, '_', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS title FROM events")
def f14(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.label_display(F.concat("event_type", F.lit("_OF_"), "event_type")).alias("title"))


NAMES = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN event_type || '.' WHEN 2 THEN 'A' || event_type WHEN 3 THEN event_type || '-' || CAST(user_id AS VARCHAR(9)) ELSE repeat(event_type, 60) END AS name FROM events"


@query("f09_valid_name", f"SELECT event_id, length(name) <= 253 AND regexp_matches(name, '^[a-z0-9][-a-z0-9.]*$') AND regexp_matches(name, '[a-z0-9]$') AS valid FROM ({NAMES})")
def f09(spark, sf_dir):
    return rows(spark, sf_dir, "events", NAMES).select("event_id", T.valid_name(F.col("name")).alias("valid"))


@query("f12_render_reference", f"""
    WITH c AS (SELECT source, doc_id, CASE doc_id % 3 WHEN 0 THEN '[' || lang || ' / ' || source || ']' || chr(10) WHEN 1 THEN '[' || source || ']' || chr(10) ELSE '' END || {STRIP_SQL.format('text')} AS t FROM documents)
    SELECT source AS k, substring(string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id), 1, 8000) AS reference FROM c GROUP BY source""")
def f12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("source").alias("k"), "doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("source"), F.when(F.col("doc_id") % 3 < 2, F.col("source")).otherwise("").alias("section"))
    return generate.render_reference(chunks, ["k"], "doc_id")


# ---------------------------------------------------------------- questions and manifests

QUESTION = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'Why is pod `web-1` stuck?' WHEN 1 THEN 'Describe the Deployment "api" in the prod namespace' WHEN 2 THEN 'pods pending on nodepool named big-one -n kube-system'
    WHEN 3 THEN 'cost of the cluster' WHEN 4 THEN 'hpa `Bad_Name` called ok-name' WHEN 5 THEN event_type WHEN 6 THEN 'PDB called a.b namespace ''x''' ELSE 'node "n1" is evicting' END AS q FROM events"""
_KIND = "CASE " + " ".join(f"WHEN contains(lower(q), '{k}') THEN '{kind}'" for k, _, kind, _ in M.RESOURCES) + " END"


def _forms_sql(forms) -> str:
    quoted = [f.replace("'", "''") for f in forms]
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(regexp_extract(q, '{f}', 1), '^[a-z0-9]([-a-z0-9.]*[a-z0-9])?$') THEN regexp_extract(q, '{f}', 1) END" for f in quoted) + ")"


_OPERATIONAL = " OR ".join(f"contains(lower(q), '{w}')" for w in M.OPERATIONAL)


@query("p28_resource_ref", f"SELECT event_id, {_KIND} AS kind FROM ({QUESTION})")
def p28(spark, sf_dir):
    return rows(spark, sf_dir, "events", QUESTION).select("event_id", M.resource_ref(F.col("q"))["kind"].alias("kind"))


@query("p29_names", f"SELECT event_id, {_forms_sql(M.NAME_FORMS)} AS name, {_forms_sql(M.NAMESPACE_FORMS)} AS namespace FROM ({QUESTION})")
def p29(spark, sf_dir):
    q = F.col("q")
    return rows(spark, sf_dir, "events", QUESTION).select("event_id", M.extract_name(q).alias("name"), M.extract_namespace(q).alias("namespace"))


@query("p30_operational", f"SELECT event_id, {_OPERATIONAL} AS operational FROM ({QUESTION})")
def p30(spark, sf_dir):
    return rows(spark, sf_dir, "events", QUESTION).select("event_id", M.is_operational(F.col("q")).alias("operational"))


@query("p31_route_tools", f"""
    WITH r AS (SELECT event_id, {_KIND} AS kind, {_forms_sql(M.NAME_FORMS)} AS name, {_OPERATIONAL} AS op FROM ({QUESTION}))
    SELECT event_id, CASE WHEN kind IS NULL OR name IS NULL THEN 'investigate_cluster' WHEN NOT op THEN 'describe_resource' WHEN kind = 'Pod' THEN 'describe_resource,list_events' ELSE 'describe_resource,list_events,investigate_cluster' END AS tools FROM r""")
def p31(spark, sf_dir):
    return rows(spark, sf_dir, "events", QUESTION).select("event_id", F.array_join(M.route_tools(F.col("q")), ",").alias("tools"))


MANIFEST = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'apiVersion: policy/v1beta1' || chr(10) || 'kind: PodDisruptionBudget' || chr(10) || 'metadata:' || chr(10) || '  name: ' || event_type
    WHEN 1 THEN 'Look:' || chr(10) || 'apiVersion: v1' || chr(10) || 'kind: Pod' || chr(10) || 'thanks for looking' WHEN 2 THEN 'kind: Pod' WHEN 3 THEN 'apiVersion: apps/v1' || chr(10) || 'kind: Deployment' || chr(10) || 'metadata: {name: a}' || chr(10) || '---' || chr(10) || 'kind: X'
    ELSE 'no manifest ' || event_type END AS t FROM events"""


#: Versions of manifests, one for each event; all deprecated ones, one that is sound, and none.
VERSIONS = [*M.DEPRECATED, "apps/v1", ""]
VERSIONED = f"""SELECT event_id, CASE event_id % {len(VERSIONS)} {' '.join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(VERSIONS))} END AS version,
    CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS kind, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'n' || CAST(user_id AS VARCHAR(9)) END AS name FROM events"""
YAML = f"""SELECT event_id, version, kind, name, CASE WHEN version = '' THEN '' ELSE 'apiVersion: ' || version || chr(10) END || CASE WHEN kind = '' THEN '' ELSE 'kind: ' || kind || chr(10) END || 'metadata:' || chr(10) ||
    CASE WHEN name = '' THEN '  labels: {{}}' ELSE '  name: ' || name END AS t FROM ({VERSIONED})"""
_NEWER = f"(VALUES {', '.join(str(x) for x in M.DEPRECATED.items())}) AS d(old, newer)"
_FINDINGS = f"""SELECT v.event_id, coalesce(nullif(concat_ws('; ', CASE WHEN version = '' THEN label || ': missing apiVersion' END, CASE WHEN kind = '' THEN 'missing kind' END,
    CASE WHEN name = '' THEN label || ': missing metadata.name' END, label || ': apiVersion ' || chr(39) || old || chr(39) || ' is deprecated; use ' || chr(39) || newer || chr(39)), ''), '{M.SOUND}') AS findings
    FROM (SELECT *, coalesce(nullif(kind, ''), 'resource') AS label FROM ({VERSIONED})) v LEFT JOIN {_NEWER} ON d.old = v.version"""


@query("p25_lint", _FINDINGS)
def p25(spark, sf_dir):
    return rows(spark, sf_dir, "events", YAML).select("event_id", M.lint_manifest(F.col("t")).alias("findings"))


@query("p26_lint_draft", f"SELECT event_id, CASE WHEN version <> '' AND kind <> '' AND findings <> '{M.SOUND}' THEN [findings] ELSE [] END AS findings FROM ({VERSIONED}) JOIN ({_FINDINGS}) USING (event_id)")
def p26(spark, sf_dir):
    draft = F.concat(F.lit("Try:\n```yaml\n"), F.col("t"), F.lit("\n```\nor so"))
    return rows(spark, sf_dir, "events", YAML).select("event_id", M.lint_draft(draft).alias("findings"))


@query("p26_extract_manifest", f"SELECT event_id, CASE event_id % 5 WHEN 1 THEN substring(t, 7, length(t) - 25) ELSE t END AS manifest FROM ({MANIFEST})")
def p26_manifest(spark, sf_dir):
    return rows(spark, sf_dir, "events", MANIFEST).select("event_id", M.extract_manifest(F.col("t")).alias("manifest"))


@query("p27_looks_like_yaml", rf"SELECT event_id, regexp_matches(t, '(?m)^\s*apiVersion:\s*\S') AND regexp_matches(t, '(?m)^\s*kind:\s*\S') AS yaml FROM ({MANIFEST})")
def p27(spark, sf_dir):
    return rows(spark, sf_dir, "events", MANIFEST).select("event_id", M.looks_like_yaml(F.col("t")).alias("yaml"))


@query("s10_split_documents", f"SELECT event_id, unnest(list_filter(list_transform(string_split(t, chr(10) || '---' || chr(10)), lambda x: {STRIP_SQL.format('x')}), lambda x: x <> '')) AS document FROM ({MANIFEST})")
def s10(spark, sf_dir):
    return rows(spark, sf_dir, "events", MANIFEST).select("event_id", F.explode(M.split_documents(F.col("t"))).alias("document"))


NESTED = """SELECT event_id, '{"a":' || CASE event_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN '""' ELSE '"' || event_type || '"' END || ',"b":{"c":[],"d":' || CASE WHEN event_id % 2 = 0 THEN '0' ELSE '{"e":null}' END || '},"f":[null,"",' || CAST(user_id AS VARCHAR(9)) || ']}' AS j FROM events"""


@query("p36_prune", f"""SELECT event_id, '{{' || CASE WHEN event_id % 3 = 2 THEN '"a":' || to_json(json_extract_string(j, '$.a')) || ',' ELSE '' END || CASE WHEN event_id % 2 = 0 THEN '"b":{{"d":0}},' ELSE '' END
    || '"f":[' || json_extract_string(j, '$.f[2]') || ']}}' AS j FROM ({NESTED})""")
def p36(spark, sf_dir):
    return rows(spark, sf_dir, "events", NESTED).select("event_id", M.prune_json(F.col("j")).alias("j"))


MESSAGE = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'did not tolerate taint a; ' || event_type || '; would EXCEED limits; insufficient cpu' WHEN 1 THEN 'did not tolerate taint b; ' || event_type WHEN 2 THEN ' ; ' ELSE 'insufficient memory' END AS m FROM events"""
_TIER = "CASE WHEN contains(lower(x), 'exceed') OR contains(lower(x), 'insufficient') THEN 0 WHEN contains(lower(x), 'did not tolerate taint') THEN 2 ELSE 1 END"


@query("p37_clauses", f"""
    WITH c AS (SELECT event_id, m, list_filter(list_transform(string_split(m, ';'), lambda x: trim(x)), lambda x: x <> '') AS l FROM ({MESSAGE})),
    u AS (SELECT event_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM c),
    o AS (SELECT event_id, list(x ORDER BY {_TIER}, i) AS l, min({_TIER}) AS tier FROM u GROUP BY event_id)
    SELECT c.event_id, CASE WHEN o.l IS NULL THEN c.m WHEN tier = 0 AND len(o.l) > 1 THEN 'PRIMARY BLOCKER: ' || o.l[1] || ' | other scheduler messages (informational only, often about other nodes/workloads on a shared cluster): ' || array_to_string(o.l[2:], '; ')
        ELSE array_to_string(o.l, '; ') END AS m FROM c LEFT JOIN o ON o.event_id = c.event_id""")
def p37(spark, sf_dir):
    return rows(spark, sf_dir, "events", MESSAGE).select("event_id", M.prioritize_clauses(F.col("m")).alias("m"))


@query("o08_clause_order", f"WITH u AS (SELECT event_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT event_id, list_filter(list_transform(string_split(m, ';'), lambda x: trim(x)), lambda x: x <> '') AS l FROM ({MESSAGE}))) SELECT event_id, i - 1 AS at, CAST({_TIER} AS INTEGER) AS tier FROM u")
def o08(spark, sf_dir):
    clauses = F.filter(F.transform(F.split("m", ";"), T.py_strip), lambda x: F.length(x) > 0)
    rows_ = rows(spark, sf_dir, "events", MESSAGE).select("event_id", F.posexplode(clauses).alias("at", "x"))
    return rows_.select("event_id", F.col("at").cast("long").alias("at"), M.clause_tier(F.col("x")).alias("tier"))


# ---------------------------------------------------------------- bounded patches

PROPOSAL = """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Deployment' ELSE 'NodePool' END AS kind, CASE event_id % 6 WHEN 0 THEN 'spec.replicas' WHEN 1 THEN 'spec.limits.cpu' WHEN 2 THEN 'spec.limits.memory' WHEN 3 THEN 'spec.replicas'
    WHEN 4 THEN 'capacity_type' ELSE 'spec.x' END AS field, CASE event_id % 6 WHEN 0 THEN CAST(event_id % 70 AS VARCHAR(9)) WHEN 1 THEN CAST(event_id % 3000 AS VARCHAR(9)) || 'm' WHEN 2 THEN CAST(event_id % 9 AS VARCHAR(9)) || 'Gi' WHEN 3 THEN event_type
    WHEN 4 THEN CASE WHEN event_id % 4 = 0 THEN 'spot' ELSE 'free' END ELSE '1' END AS value FROM events"""


@query("b01_validate_patch", f"""
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(value AS INTEGER) <= 50 WHEN 1 THEN CAST(replace(value, 'm', '') AS DOUBLE) / 1000 >= 1 WHEN 2 THEN CAST(replace(value, 'Gi', '') AS INTEGER) >= 4 WHEN 4 THEN value = 'spot' ELSE false END AS ok,
        CASE event_id % 6 WHEN 0 THEN CASE WHEN CAST(value AS INTEGER) > 50 THEN 'must be <= 50' END WHEN 1 THEN CASE WHEN CAST(replace(value, 'm', '') AS DOUBLE) / 1000 < 1 THEN 'must be >= 1' END
            WHEN 2 THEN CASE WHEN CAST(replace(value, 'Gi', '') AS INTEGER) < 4 THEN 'must be >= 4Gi' END WHEN 3 THEN 'not a valid integer' WHEN 4 THEN CASE WHEN value <> 'spot' THEN 'must be one of spot, on-demand, reserved' END
            ELSE 'spec.x is not an allowed field for ' || kind END AS error FROM ({PROPOSAL})""")
def b01(spark, sf_dir):
    return patches.validate_patch(rows(spark, sf_dir, "events", PROPOSAL), patches.patch_schema(spark)).select("event_id", "ok", "error")


#: A node pool for each event, what its cpu limit is to be, and what it shows afterwards (now and then in other units).
AMOUNTS = """SELECT event_id, event_type, user_id % 40 + 1 AS cores, CASE event_id % 3 WHEN 0 THEN CAST((user_id % 40 + 1) * 1000 AS VARCHAR(9)) || 'm' WHEN 1 THEN CAST(user_id % 40 + 1 AS VARCHAR(9)) ELSE CAST(event_id % 40 + 1 AS VARCHAR(9)) END AS shown,
    event_id % 40 + 1 AS other, event_id % 3 AS form FROM events"""


@query("b02_verify_quantity", f"SELECT event_id, form < 2 OR cores = other AS verified FROM ({AMOUNTS})")
def b02_quantity(spark, sf_dir):
    resource = F.concat(F.lit('{"spec":{"limits":{"cpu":"'), "shown", F.lit('"}}}'))
    df = rows(spark, sf_dir, "events", AMOUNTS).select("event_id", resource.alias("resource"), F.lit("spec.limits.cpu").alias("field"), F.lit("set_quantity").alias("verb"), F.col("cores").cast("string").alias("normal"))
    return patches.shown(df.withColumn("node_keys", F.array().cast("array<string>"))).select("event_id", "verified")


RESOURCE = """SELECT event_id, '{"spec":{"replicas":' || CAST(event_id % 5 AS VARCHAR(9)) || ',"template":{"spec":{"nodeSelector":{"zone":"a","' || event_type || '":"x"},"requirements":[{"key":"karpenter.sh/capacity-type","values":["spot"]}]}}}}' AS resource,
    CASE event_id % 3 WHEN 0 THEN 'spec.replicas' WHEN 1 THEN 'capacity_type' ELSE 'spec.template.spec.nodeSelector' END AS field, CASE event_id % 3 WHEN 0 THEN 'set_int' WHEN 1 THEN 'add_to_set' ELSE 'remove_unschedulable_nodeselector_keys' END AS verb,
    CASE event_id % 3 WHEN 0 THEN CAST(user_id % 50 AS VARCHAR(9)) WHEN 1 THEN CASE WHEN user_id % 2 = 0 THEN 'spot' ELSE 'on-demand' END ELSE '' END AS normal, event_type, user_id FROM events"""


@query("b02_apply_patch", f"""
    WITH r AS ({RESOURCE}), s AS (SELECT *, ['spot'] AS held, list_filter(['zone', event_type], lambda k: k IN ('zone', 'arch')) AS known FROM r)
    SELECT event_id, (verb = 'add_to_set' AND list_contains(held, normal)) OR (verb LIKE 'remove%' AND len(known) = 2) AS noop, true AS verified,
        CASE verb WHEN 'set_int' THEN normal WHEN 'add_to_set' THEN array_to_string(list_sort(list_distinct(list_append(held, normal))), ',') ELSE array_to_string(list_distinct(known), ',') END AS now FROM s""")
def b02(spark, sf_dir):
    df = rows(spark, sf_dir, "events", RESOURCE).withColumn("node_keys", F.array(F.lit("zone"), F.lit("arch")))
    out = patches.apply_patches(df)
    values = F.array_join(F.from_json(F.get_json_object("after", "$.spec.template.spec.requirements[0].values"), "array<string>"), ",")
    keys = F.array_join(F.map_keys(F.from_json(F.get_json_object("after", "$.spec.template.spec.nodeSelector"), "map<string,string>")), ",")
    now = F.when(F.col("verb") == "set_int", F.get_json_object("after", "$.spec.replicas")).when(F.col("verb") == "add_to_set", values).otherwise(keys)
    return out.select("event_id", F.col("patch").isNull().alias("noop"), "verified", now.alias("now"))


@query("j14_unschedulable", "SELECT DISTINCT event_id AS name, event_type AS key FROM events WHERE event_type NOT IN (SELECT event_type FROM events WHERE event_id % 1000 = 0)")
def j14(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    selectors = e.select(F.col("event_id").alias("name"), F.create_map("event_type", F.lit("x")).alias("selector"))
    return patches.unschedulable_keys(selectors, e.where("event_id % 1000 = 0").select(F.create_map("event_type", F.lit("y")).alias("labels")))


@query("u06_with_member", "SELECT doc_id, array_to_string(list_sort(list_distinct([lang, source, 'm'])), ',') AS s FROM documents")
def u06(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(patches.with_member(F.array("lang", "source"), F.lit("m")), ",").alias("s"))


