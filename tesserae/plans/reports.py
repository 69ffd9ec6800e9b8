"""Registered queries over report aggregates, scorecards of cases and sizes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import cases, metrics, records, reports, retrieve, scorecard, sizing
from tesserae.plans.base import PREDICTED, RECORDS, STATUS, query, rows
from tesserae.session import table


@query("a02_low_labels", "SELECT source AS label, count(*) AS n FROM documents GROUP BY source HAVING count(*) < 50")
def a02(spark, sf_dir):
    return reports.low_labels(table(spark, sf_dir, "documents"), "source", 50)


@query("a08_review", "SELECT lang AS label, 2 * count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 9) AS pct, 2 * count(*) < 400 AS low FROM documents GROUP BY lang")
def a08(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return reports.review(docs, docs, "lang", 400).withColumn("pct", F.round("pct", 9))


_TOKENS = "SELECT conv_id, turn, text, unnest(l) AS token, generate_subscripts(l, 1) AS i FROM (SELECT conv_id, turn, text, regexp_extract_all(role || ' ' || text || chr(10) || 'x', '\\S+\\s*') AS l FROM conversations)"
LOGPROB = "-0.01 * (length(token) + i % 7)"


@query("a19_logprob_confidence", f"""
    WITH t AS (SELECT conv_id * 1000 + turn AS id, i, CASE WHEN i = 2 AND turn % 2 = 0 THEN '</think>' WHEN turn % 5 = 4 THEN ' ' ELSE token END AS token, {LOGPROB} AS lp FROM ({_TOKENS})),
    s AS (SELECT *, coalesce(max(CASE WHEN contains(token, '</think>') THEN i END) OVER (PARTITION BY id), -1) AS started FROM t),
    k AS (SELECT *, min(CASE WHEN i > started AND trim(token, ' ' || chr(10) || chr(9) || chr(13)) <> '' THEN i END) OVER (PARTITION BY id) AS first FROM s),
    e AS (SELECT *, min(CASE WHEN i > started AND i > first AND contains(token, chr(10)) THEN i END) OVER (PARTITION BY id) AS stop FROM k)
    SELECT id, coalesce(round(100 * exp(avg(CASE WHEN i > started AND trim(token, ' ' || chr(10) || chr(9) || chr(13)) <> '' AND (stop IS NULL OR i < stop) THEN lp END)), 1), -1) AS confidence FROM e GROUP BY id""")
def a19(spark, sf_dir):
    words = F.regexp_extract_all(F.concat("role", F.lit(" "), "text", F.lit("\nx")), F.lit(r"\S+\s*"), 0)
    t = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn", F.posexplode(words).alias("i", "token")).withColumn("i", F.col("i") + 1)
    t = t.withColumn("lp", F.expr(LOGPROB).cast("double"))
    t = t.withColumn("token", F.when((F.col("i") == 2) & (F.col("turn") % 2 == 0), "</think>").when(F.col("turn") % 5 == 4, " ").otherwise(F.col("token")))
    return metrics.logprob_confidence(t, "id", "i", "token", "lp")


@query("a20_judged", "SELECT round(CAST(count(*) FILTER (WHERE event_id % 3 = 0) AS DOUBLE) / count(*) * 100, 6) AS accuracy, round_even(avg(CASE WHEN event_id % 4 > 0 THEN value END), 1) AS confidence FROM events")
def a20(spark, sf_dir):
    confidence = F.when(F.col("event_id") % 4 > 0, F.col("value")).otherwise(-1.0)
    out = reports.judged(table(spark, sf_dir, "events").select(confidence.alias("confidence"), (F.col("event_id") % 3 == 0).alias("correct")))
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query("a23_classes", "SELECT array_to_string(list_sort(list(DISTINCT source)), ',') AS classes FROM documents")
def a23(spark, sf_dir):
    return reports.distinct_sorted(table(spark, sf_dir, "documents"), "source").select(F.array_join("classes", ",").alias("classes"))


@query("a26_deltas", "SELECT event_id, CASE WHEN t >= b THEN '+' ELSE '' END || printf('%.1f pts', (t - b) * 100) AS points, round(CASE WHEN b > 0 THEN (t - b) / b * 100 END, 6) AS better FROM (SELECT event_id, (event_id % 64) / 64.0 AS b, (event_id % 32) / 32.0 AS t FROM events)")
def a26(spark, sf_dir):
    base, tuned = F.col("event_id") % 64 / 64, F.col("event_id") % 32 / 32
    return table(spark, sf_dir, "events").select("event_id", reports.points_gained(base, tuned).alias("points"), F.round(reports.percent_better(base, tuned, False), 6).alias("better"))


@query("a27_run_seconds", "SELECT user_id, round_even(sum(value * 0.01739), 1) AS seconds FROM events GROUP BY user_id")
def a27(spark, sf_dir):
    return reports.run_seconds(table(spark, sf_dir, "events").select("user_id", (F.col("value") * 0.01739).alias("seconds")), "user_id")


@query("a28_max_tokens", """
    WITH t AS (SELECT length(text) AS n, length(text) // 4 AS t, row_number() OVER (ORDER BY length(text) // 4) - 1 AS i, count(*) OVER () AS c FROM documents WHERE length(text) > 0)
    SELECT (SELECT avg(length(text)) FROM documents) AS avg_chars, CAST(greatest(32, floor(min(CASE WHEN i = least(floor(c * 0.95), c - 1) THEN t END) * 1.5)) AS BIGINT) AS max_tokens FROM t""")
def a28(spark, sf_dir):
    return reports.dynamic_max_tokens(table(spark, sf_dir, "documents").select(F.col("text").alias("output")))


@query("o01_distribution_order", "SELECT source AS label, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) AS INTEGER) AS place FROM documents GROUP BY source")
def o01(spark, sf_dir):
    return reports.ordered_distribution(table(spark, sf_dir, "documents"), "source", "doc_id")


@query("o02_first_target", "SELECT doc_id, output FROM (SELECT doc_id, output, row_number() OVER (ORDER BY source, doc_id) AS r FROM (SELECT doc_id, source, lang AS output FROM documents)) WHERE r <= 25")
def o02(spark, sf_dir):
    return reports.head_rows(table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("output")), ["source", "doc_id"], 25).select("doc_id", "output")


@query("o03_head", "SELECT event_id, event_type FROM events ORDER BY ts, event_id LIMIT 15")
def o03(spark, sf_dir):
    return reports.head_rows(table(spark, sf_dir, "events"), ["ts", "event_id"]).select("event_id", "event_type")


@query("o06_weakest_categories", f"""
    SELECT source AS category, count(*) AS total, CAST(sum(CASE WHEN gold = predicted THEN 1 ELSE 0 END) AS BIGINT) AS correct, round(avg(CASE WHEN gold = predicted THEN 1.0 ELSE 0 END), 9) AS accuracy
    FROM (SELECT p.*, d.source FROM ({PREDICTED}) p JOIN documents d ON d.doc_id = p.doc_id) GROUP BY source HAVING count(*) >= 2 ORDER BY avg(CASE WHEN gold = predicted THEN 1.0 ELSE 0 END), source LIMIT 5""")
def o06(spark, sf_dir):
    named = rows(spark, sf_dir, "documents", PREDICTED).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return reports.weakest_categories(named, "source", "gold", "predicted").withColumn("accuracy", F.round("accuracy", 9))


@query("o07_sample", "SELECT doc_id, source FROM documents ORDER BY md5('3|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 40")
def o07(spark, sf_dir):
    return records.sample_n(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 40, 3)


@query("o09_preview", f"""
    SELECT doc_id, CASE WHEN length(instruction) > 80 THEN substring(instruction, 1, 80) || '...' ELSE instruction END AS instruction,
        CASE WHEN length(input) > 120 THEN substring(replace(input, chr(10), ' '), 1, 120) || '...' ELSE replace(input, chr(10), ' ') END AS input, output FROM ({RECORDS}) ORDER BY doc_id LIMIT 3""")
def o09(spark, sf_dir):
    return reports.preview(rows(spark, sf_dir, "documents", RECORDS), ["doc_id"])


@query("w06_tail_fallback", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= (SELECT count(*) - greatest(1, count(*) // 10) FROM documents) THEN 'train' ELSE 'eval' END AS split FROM documents")
def w06(spark, sf_dir):
    return records.split_positional(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 1.0)


@query("w09_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def w09(spark, sf_dir):
    return reports.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


PATHS = "SELECT 'models/x/' || CASE event_id % 4 WHEN 0 THEN 'checkpoint-' WHEN 1 THEN 'final-' WHEN 2 THEN 'checkpoint-x' ELSE 'a/checkpoint-' END || CAST(event_id AS VARCHAR(9)) || CASE WHEN event_id % 3 = 0 THEN '/' ELSE '' END AS path FROM events"


@query("s11_latest_checkpoint", rf"SELECT path, CAST(regexp_extract(path, '/checkpoint-([0-9]+)/?$', 1) AS BIGINT) AS step FROM ({PATHS}) WHERE regexp_matches(path, '/checkpoint-[0-9]+/?$') ORDER BY step DESC LIMIT 1")
def s11(spark, sf_dir):
    return reports.latest_checkpoint(rows(spark, sf_dir, "events", PATHS))


CURVE = "SELECT event_id AS step, CASE WHEN event_id % 3 > 0 THEN value * 0.0173 END AS loss, CASE WHEN event_id % 3 = 0 THEN value * 0.02 END AS eval_loss FROM events"


@query("s11_training_curve", f"SELECT count(loss) AS losses, count(eval_loss) AS eval_losses, round_even(arg_min(loss, step) FILTER (WHERE loss IS NOT NULL), 4) AS start_loss, round_even(arg_max(loss, step) FILTER (WHERE loss IS NOT NULL), 4) AS final_loss, round_even(min(loss), 4) AS min_loss, max(step) AS total_steps FROM ({CURVE})")
def s11_curve(spark, sf_dir):
    return reports.training_curve(rows(spark, sf_dir, "events", CURVE))


@query("s12_cheapest", "SELECT min(p) AS hourly FROM (SELECT arg_max(value, event_id) AS p FROM events GROUP BY event_type)")
def s12(spark, sf_dir):
    return reports.cheapest(table(spark, sf_dir, "events").select(F.col("event_type").alias("instance"), F.col("event_id").alias("at"), F.col("value").alias("price")), 0.16)


@query("s15_of_source", "SELECT doc_id, text FROM documents WHERE source = 'src3'")
def s15(spark, sf_dir):
    from tesserae.sources.artifacts import of_source

    return of_source(table(spark, sf_dir, "documents"), "src3").select("doc_id", "text")


# ---------------------------------------------------------------- cases

CASE = """SELECT event_id, event_id % 7 = 0 AS should_reject, CASE event_id % 3 WHEN 0 THEN 'CLICK' WHEN 1 THEN event_type ELSE NULL END AS expected_category, event_id % 11 = 0 AS should_abstain, CASE WHEN event_id % 13 = 0 THEN true END AS config_is_valid,
    event_id % 17 = 0 AS leading_premise, CASE WHEN event_id % 14 = 0 THEN 'This does not look like a question' ELSE 'use ' || event_type || ' now' END AS answer, CASE WHEN event_id % 5 = 0 THEN 'Reject' ELSE event_type || ' high' END AS triage,
    CASE event_id % 4 WHEN 0 THEN 'partial' WHEN 1 THEN 'fail' ELSE 'pass' END AS verdict, event_id % 2 = 0 AS abstained, event_id % 26 = 0 AS invented_problem, event_id % 34 = 0 AS followed_wrong_premise, CASE WHEN event_id % 19 = 0 THEN true END AS hallucinated FROM events"""
_REJECTED = "contains(lower(triage), 'reject') OR contains(lower(answer), 'does not look like')"
_TRIAGE_OK = f"CASE WHEN should_reject THEN {_REJECTED} ELSE coalesce(lower(expected_category), '') = '' OR contains(lower(triage), lower(expected_category)) END"
_SAID = "list_filter(['VIEW', 'use click'], lambda p: contains(lower(answer), lower(p)))"
_OFF = "(should_abstain AND NOT abstained) OR (coalesce(config_is_valid, false) AND invented_problem) OR (leading_premise AND followed_wrong_premise)"


def case_rows(spark, sf_dir):
    judge = F.struct("verdict", "abstained", "invented_problem", "followed_wrong_premise", "hallucinated")
    return rows(spark, sf_dir, "events", CASE).withColumn("must_not_say", F.array(F.lit("VIEW"), F.lit("use click"))).withColumn("judge", judge)


@query("e01_score_cases", f"""
    SELECT event_id, array_to_string({_SAID}, ',') AS violations, CASE WHEN should_reject THEN CASE WHEN {_TRIAGE_OK} THEN 'pass' ELSE 'fail' END
        WHEN len({_SAID}) > 0 OR {_OFF} OR verdict = 'fail' THEN 'fail' WHEN verdict = 'partial' OR coalesce(hallucinated, false) THEN 'partial' ELSE 'pass' END AS status FROM ({CASE})""")
def e01(spark, sf_dir):
    return cases.score_cases(case_rows(spark, sf_dir)).select("event_id", F.array_join("violations", ",").alias("violations"), "status")


@query("p18_triage_check", f"SELECT event_id, {_TRIAGE_OK} AS triage FROM ({CASE})")
def p18(spark, sf_dir):
    return cases.score_cases(case_rows(spark, sf_dir)).select("event_id", "checks.triage")


@query("p21_calibration", f"SELECT event_id, CASE WHEN NOT should_reject THEN NOT ({_OFF}) END AS calibration FROM ({CASE})")
def p21(spark, sf_dir):
    return cases.score_cases(case_rows(spark, sf_dir)).select("event_id", "checks.calibration")


@query("p22_only", "SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def p22(spark, sf_dir):
    return cases.only(table(spark, sf_dir, "events"), " click, view ,", "event_type").select("event_id")


RUNS = f"SELECT user_id, event_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE {STATUS} END AS status, value * 0.01739 AS seconds FROM events"


@query("e02_repeated_runs", f"""
    WITH r AS (SELECT user_id, event_id, coalesce(status, 'error') AS status, seconds FROM ({RUNS})), c AS (SELECT user_id, status, count(*) AS n FROM r GROUP BY 1, 2),
    v AS (SELECT user_id, status, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, CASE status WHEN 'error' THEN 0 WHEN 'fail' THEN 1 WHEN 'partial' THEN 2 ELSE 3 END) AS k FROM c),
    d AS (SELECT user_id, string_agg(status, ',' ORDER BY event_id) AS runs, CAST(count(*) FILTER (WHERE status = 'pass') AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR) AS pass_rate, round_even(sum(seconds), 1) AS seconds FROM r GROUP BY user_id)
    SELECT v.user_id, v.status, d.runs, d.pass_rate, d.seconds FROM v JOIN d ON d.user_id = v.user_id WHERE k = 1""")
def e02(spark, sf_dir):
    return cases.repeated(rows(spark, sf_dir, "events", RUNS), "user_id", "event_id").withColumn("runs", F.array_join("runs", ","))


@query("e04_totals", f"""
    SELECT count(*) FILTER (WHERE s = 'pass') AS pass, count(*) FILTER (WHERE s = 'partial') AS partial, count(*) FILTER (WHERE s = 'fail') AS fail, count(*) FILTER (WHERE s = 'error') AS error, count(*) AS n, bool_or(s IN ('fail', 'error')) AS failed
    FROM (SELECT {STATUS} AS s FROM events)""")
def e04(spark, sf_dir):
    return cases.totals(table(spark, sf_dir, "events").select(F.expr(STATUS).alias("status")))


@query("st2_relay", """
    WITH r AS (SELECT user_id AS run, event_type AS step, event_id AS seq, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events)
    SELECT run, step, seq, 0 AS part, 'step_done' AS type, 'time to first token' AS text, value AS ms FROM r WHERE k = 1 UNION ALL SELECT run, step, seq, 1, 'token', step, NULL FROM r""")
def st2(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("step"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"), F.col("value").alias("ms"))
    return cases.relayed(e, "run", "step", "seq", "text", "ms")


# ---------------------------------------------------------------- sizes

CONFIG = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'scoring' ELSE 'generation' END AS task, CASE event_id % 7 WHEN 0 THEN 'a-1.7B' WHEN 1 THEN 'a-4b' WHEN 2 THEN 'a-8b' WHEN 3 THEN 'a-13b' WHEN 4 THEN 'a-3B' WHEN 5 THEN 'a-0.6b' ELSE event_type END AS base,
    CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'q8_0' WHEN 2 THEN 'f16' ELSE 'q5_k_m' END AS quantize, CAST(event_id % 5000 AS INTEGER) AS pairs, CAST(CASE WHEN event_id % 3 = 0 THEN event_id % 9 END AS INTEGER) AS epochs FROM events"""


@query("q02_auto_size", f"""
    WITH s AS (SELECT *, CASE event_id % 7 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 13 WHEN 4 THEN 3 WHEN 5 THEN 1 ELSE 7 END AS size, task <> 'generation' AS enc, CASE WHEN quantize IN ('none', 'f16') THEN 3 WHEN quantize = 'q8_0' THEN 2 ELSE 1 END AS q,
        CASE WHEN pairs > 0 THEN pairs * 3 ELSE 5000 END AS samples FROM ({CONFIG})),
    b AS (SELECT *, CASE WHEN size <= 3 THEN 1 WHEN size <= 5 THEN 2 WHEN size <= 8 THEN 3 ELSE 4 END AS r FROM s)
    SELECT event_id, CASE WHEN enc THEN '2' ELSE ['4', '4', '8', '16'][r] END AS cpu, CASE WHEN enc THEN '4Gi' ELSE [['6Gi', '6Gi', '12Gi'], ['8Gi', '10Gi', '16Gi'], ['16Gi', '16Gi', '24Gi'], ['24Gi', '28Gi', '40Gi']][r][q] END AS memory,
        CASE WHEN NOT enc THEN [500, 250, 100, 50][r] END AS checkpoint_steps, CASE WHEN NOT enc THEN ['16Gi', '24Gi', '40Gi', '56Gi'][r] END AS convert_memory, CASE WHEN NOT enc THEN ['40Gi', '48Gi', '64Gi', '72Gi'][r] END AS convert_disk,
        CAST(CASE WHEN epochs > 0 THEN epochs WHEN enc THEN 1 WHEN samples < 10000 THEN 5 ELSE 3 END AS INTEGER) AS sized_epochs, CASE WHEN NOT enc THEN CASE WHEN epochs >= 6 THEN 4 ELSE 2 END END AS patience, CASE WHEN NOT enc THEN CASE WHEN size <= 7 THEN 2e-4 ELSE 1e-4 END END AS learning_rate FROM b""")
def q02(spark, sf_dir):
    return sizing.auto_size(rows(spark, sf_dir, "events", CONFIG)).drop("task", "base", "quantize", "pairs", "epochs", "threads")


@query("q03_token_budget", "SELECT event_id, event_id % 900 + (event_id % 900) // 5 AS tokens, CASE WHEN event_id % 2 = 0 THEN (event_id % 700) // 2 ELSE 0 END AS reasoning FROM events")
def q03(spark, sf_dir):
    tokens, reasoning = scorecard.token_budget(F.col("event_id") % 900, F.col("event_id") % 700, F.col("event_id") % 2 == 0)
    return table(spark, sf_dir, "events").select("event_id", tokens.alias("tokens"), reasoning.alias("reasoning"))


@query("m25_concurrency", "SELECT event_id, CASE WHEN event_id % 900 > 0 THEN greatest(5, least(20, CAST(floor((event_id % 900) * 0.8 * 3 / 60) AS INTEGER))) ELSE 20 END AS calls FROM events")
def m25(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", sizing.concurrency(F.col("event_id") % 900).alias("calls"))


# ---------------------------------------------------------------- places

LISTS = "SELECT user_id AS query_id, event_id % 4 AS list, event_id % 97 AS doc_id, row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY event_id) AS rank FROM events"


@query("m10_hybrid_candidates", f"""
    WITH l AS (SELECT query_id, doc_id, min(list * 100000 + rank) AS o FROM ({LISTS}) WHERE (list = 0 AND rank <= 6) OR (list = 1 AND rank <= 5) GROUP BY 1, 2)
    SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o) AS INTEGER) AS place FROM l""")
def m10(spark, sf_dir):
    lists = rows(spark, sf_dir, "events", LISTS)
    return retrieve.hybrid(lists.where("list = 0"), lists.where("list = 1"), 4, 3, broaden=2)


@query("o10_candidate_caps", f"SELECT query_id, count(*) AS n FROM (SELECT DISTINCT query_id, doc_id FROM ({LISTS}) WHERE (list = 2 AND rank <= 30) OR (list = 3 AND rank <= 15)) GROUP BY query_id")
def o10(spark, sf_dir):
    lists = rows(spark, sf_dir, "events", LISTS)
    return retrieve.hybrid(lists.where("list = 2"), lists.where("list = 3")).groupBy("query_id").agg(F.count("*").alias("n"))


@query("j12_side_by_side", """
    WITH a AS (SELECT row_number() OVER (ORDER BY event_id) AS place, event_type FROM events), b AS (SELECT row_number() OVER (ORDER BY event_id) AS place, event_type FROM events WHERE event_id % 3 = 0)
    SELECT CAST(a.place AS INTEGER) AS place, a.event_type AS a_event_type, b.event_type AS b_event_type FROM a JOIN b ON a.place = b.place WHERE a.place <= 15""")
def j12(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return retrieve.side_by_side(e, e.where("event_id % 3 = 0"), ["event_id"], ["event_type"])


@query("j15_by_index", "SELECT event_id, [event_type, 'b', CAST(user_id AS VARCHAR)][event_id % 4 + 1] AS text FROM events")
def j15(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.array("event_type", F.lit("b"), F.col("user_id").cast("string")).alias("documents"), (F.col("event_id") % 4).cast("int").alias("index"))
    return retrieve.by_index(e).select("event_id", "text")


