"""The registered queries over records, profiles, metrics, joins, tokens and events, with their SQL.

"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import chunk, lexical_index, metrics, profile, records, retrieve, scorecard, tagger
from tesserae.operators.written import shared_folder
from tesserae.plans.base import LABELS, ORACLES, OUTPUT, PREDICTED, QUERIES, RECORDS, SCORED, STATUS, STRIP_SQL, TOKEN_SQL, UNIT, UNIT_SQL, query, rows
from tesserae.session import table
from tesserae.sources import files
from tesserae.streaming import runs

__all__ = ["ORACLES", "OUTPUT", "QUERIES"]

# ---------------------------------------------------------------- chunks


@query("c01_chunk_profile", r"""
    WITH RECURSIVE parts AS (SELECT doc_id, source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
    paras AS (SELECT doc_id, source, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 0) AS p FROM parts),
    fold AS (
        SELECT doc_id, 0 AS i, '' AS buf, CAST(NULL AS VARCHAR) AS done FROM paras WHERE length(t) >= 200
        UNION ALL
        SELECT f.doc_id, f.i + 1,
            CASE WHEN length(f.buf) >= 200 AND length(f.buf) + length(p.p[f.i + 1]) + 2 > 1200 THEN right(f.buf, 150) || chr(10) || chr(10) || p.p[f.i + 1]
                 WHEN f.buf = '' THEN p.p[f.i + 1] ELSE f.buf || chr(10) || chr(10) || p.p[f.i + 1] END,
            CASE WHEN length(f.buf) >= 200 AND length(f.buf) + length(p.p[f.i + 1]) + 2 > 1200 THEN f.buf END
        FROM fold f JOIN paras p ON p.doc_id = f.doc_id WHERE f.i < len(p.p)),
    chunks AS (
        SELECT doc_id, regexp_replace(done, '^\s+|\s+$', '', 'g') AS c FROM fold WHERE done IS NOT NULL
        UNION ALL SELECT f.doc_id, regexp_replace(f.buf, '^\s+|\s+$', '', 'g') FROM fold f JOIN paras p ON p.doc_id = f.doc_id WHERE f.i = len(p.p) AND length(regexp_replace(f.buf, '^\s+|\s+$', '', 'g')) >= 200
        UNION ALL SELECT doc_id, t FROM paras WHERE length(t) < 200 AND length(t) > 0)
    SELECT d.source, count(*) AS n_chunks, CAST(sum(length(c.c)) AS BIGINT) AS n_chars FROM chunks c JOIN documents d ON d.doc_id = c.doc_id GROUP BY d.source""")
def c01_chunk_profile(spark, sf_dir):
    out = chunk.chunk_paragraphs(table(spark, sf_dir, "documents"), ["source"], sep="\n")
    return out.groupBy("source").agg(F.count("*").alias("n_chunks"), F.sum(F.length("chunk")).alias("n_chars"))


BLANK_LINES = "SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents"


@query("c01_paragraph_chunks", rf"""
    WITH RECURSIVE parts AS (SELECT doc_id, {STRIP_SQL.format('text')} AS t FROM ({BLANK_LINES})),
    paras AS (SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: {STRIP_SQL.format('x')}), lambda x: length(x) > 0) AS p FROM parts),
    fold AS (
        SELECT doc_id, 0 AS i, '' AS buf, CAST(NULL AS VARCHAR) AS done FROM paras WHERE length(t) >= 200
        UNION ALL
        SELECT f.doc_id, f.i + 1,
            CASE WHEN length(f.buf) >= 200 AND length(f.buf) + length(p.p[f.i + 1]) + 2 > 1200 THEN right(f.buf, 150) || chr(10) || chr(10) || p.p[f.i + 1]
                 WHEN f.buf = '' THEN p.p[f.i + 1] ELSE f.buf || chr(10) || chr(10) || p.p[f.i + 1] END,
            CASE WHEN length(f.buf) >= 200 AND length(f.buf) + length(p.p[f.i + 1]) + 2 > 1200 THEN f.buf END
        FROM fold f JOIN paras p ON p.doc_id = f.doc_id WHERE f.i < len(p.p)),
    chunks AS (
        SELECT doc_id, i, {STRIP_SQL.format('done')} AS c FROM fold WHERE done IS NOT NULL
        UNION ALL SELECT f.doc_id, f.i + 1, {STRIP_SQL.format('f.buf')} FROM fold f JOIN paras p ON p.doc_id = f.doc_id WHERE f.i = len(p.p) AND length({STRIP_SQL.format('f.buf')}) >= 200
        UNION ALL SELECT doc_id, 0, t FROM paras WHERE length(t) < 200 AND length(t) > 0)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_no, c AS chunk FROM chunks""")
def c01_default(spark, sf_dir):
    return chunk.chunk_paragraphs(rows(spark, sf_dir, "documents", BLANK_LINES), ["doc_id"])


#: Documents with front matter, with headings after sentences, with headings at lines, and as they are.
SECTIONED = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) || text
    WHEN 1 THEN replace(text, '. ', '.' || chr(10) || '## ') WHEN 2 THEN replace(text, chr(10), chr(10) || '# ') ELSE text END AS text FROM documents"""


@query("c02_section_chunks", rf"""
    WITH RECURSIVE body AS (
        SELECT doc_id, CASE WHEN starts_with(text, '---') AND instr(substring(text, 4), '---') > 0
            THEN {STRIP_SQL.format("substring(text, instr(substring(text, 4), '---') + 6)")} ELSE text END AS t FROM ({SECTIONED})),
    lines AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM body),
    fold AS (
        SELECT doc_id, 0 AS i, '' AS buf, '' AS section, CAST(NULL AS VARCHAR) AS done, '' AS of FROM lines
        UNION ALL
        SELECT f.doc_id, f.i + 1,
            CASE WHEN regexp_matches(l.l[f.i + 1], '^#{{1,6}}\s+\S') THEN l.l[f.i + 1] || chr(10)
                 WHEN length(f.buf) + length(l.l[f.i + 1]) + 1 > 2000 THEN right(f.buf || l.l[f.i + 1] || chr(10), 200) ELSE f.buf || l.l[f.i + 1] || chr(10) END,
            CASE WHEN regexp_matches(l.l[f.i + 1], '^#{{1,6}}\s+\S') THEN {STRIP_SQL.format("ltrim(l.l[f.i + 1], '#')")} ELSE f.section END,
            CASE WHEN regexp_matches(l.l[f.i + 1], '^#{{1,6}}\s+\S') THEN CASE WHEN length({STRIP_SQL.format('f.buf')}) > 100 THEN f.buf END
                 WHEN length(f.buf) + length(l.l[f.i + 1]) + 1 > 2000 THEN f.buf || l.l[f.i + 1] END,
            f.section
        FROM fold f JOIN lines l ON l.doc_id = f.doc_id WHERE f.i < len(l.l)),
    chunks AS (
        SELECT doc_id, i, of AS section, {STRIP_SQL.format('done')} AS c FROM fold WHERE done IS NOT NULL
        UNION ALL SELECT f.doc_id, f.i + 1, f.section, {STRIP_SQL.format('f.buf')} FROM fold f JOIN lines l ON l.doc_id = f.doc_id WHERE f.i = len(l.l) AND length({STRIP_SQL.format('f.buf')}) > 50)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_no, section, c AS chunk FROM chunks""")
def c02_section_chunks(spark, sf_dir):
    return chunk.chunk_sections(rows(spark, sf_dir, "documents", SECTIONED), ["doc_id"])


# ---------------------------------------------------------------- records


@query("p01_nonempty", f"SELECT doc_id, output FROM ({RECORDS}) WHERE length(trim(output)) > 0")
def p01(spark, sf_dir):
    return records.nonempty(rows(spark, sf_dir, "documents", RECORDS)).select("doc_id", "output")


@query("p02_prompt_text", f"SELECT doc_id, CASE WHEN instruction <> '' THEN instruction || chr(10) || chr(10) || input ELSE input END AS prompt FROM ({RECORDS})")
def p02(spark, sf_dir):
    return rows(spark, sf_dir, "documents", RECORDS).select("doc_id", records.prompt_text(F.col("instruction"), F.col("input")).alias("prompt"))


@query("p03_truncate", "SELECT doc_id, substring(text, 1, 4000) AS t FROM documents")
def p03(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 4000).alias("t"))


_FULL = "list_filter(list_transform(string_split(output, '|'), lambda x: trim(x)), lambda x: length(x) > 0)"
for _mode, _id, _sql in (
    ("first", "p04", "CASE WHEN contains(output, '|') THEN trim(string_split(output, '|')[1]) ELSE trim(output) END"),
    ("report", "p05", f"coalesce({_FULL}[2], {_FULL}[1], trim(output))"),
    ("taxonomy", "p06", f"list_filter({_FULL}, lambda x: x IN {LABELS})[1]"),
    ("cli", "p07", "trim(CASE WHEN instr(output, '|') > 1 THEN string_split(output, '|')[1] ELSE output END)"),
):
    @query(f"{_id}_label_{_mode}", f"SELECT doc_id, {_sql} AS label FROM ({RECORDS})")
    def _label(spark, sf_dir, mode=_mode):
        label = T.primary_label(F.col("output"), mode, list(LABELS) if mode == "taxonomy" else None)
        return rows(spark, sf_dir, "documents", RECORDS).select("doc_id", label.alias("label"))


NUMBER_SQL = r"^[+-]?([0-9]+(_[0-9]+)*\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@query("p08_validate_scores", rf"""
    WITH t AS (SELECT event_id, output, string_split(trim(replace(replace(output, '%', ''), '"', '')), ' ')[1] AS tok FROM ({SCORED})),
    v AS (SELECT event_id, output, CASE WHEN regexp_matches(tok, '{NUMBER_SQL}') THEN CAST(replace(tok, '_', '') AS DOUBLE) END AS v FROM t),
    w AS (SELECT event_id, CASE WHEN v > 1 AND contains(output, '%') THEN v / 100 ELSE v END AS v FROM v)
    SELECT event_id, printf('%.4f', v) AS score FROM w WHERE v >= 0 AND v <= 1""")
def p08(spark, sf_dir):
    return rows(spark, sf_dir, "events", SCORED).select("event_id", T.parsed_score(F.col("output")).alias("score")).where("score is not null")


ENTITY = "SELECT doc_id, text AS input, 'LANG :: ' || lang || ' || WORD :: ' || split_part(text, ' ', 1) || ' || NONE :: zzzz || WORD ::' AS output FROM documents"


@query("p10_validate_entities", f"""
    SELECT doc_id, array_to_string(list_filter(['LANG :: ' || l, 'WORD :: ' || w], lambda x: contains(input, substring(x, 9)) AND length(x) > 8), ' || ') AS output
    FROM (SELECT doc_id, text AS input, lang AS l, trim(split_part(text, ' ', 1)) AS w FROM documents) WHERE contains(input, l) OR (w <> '' AND contains(input, w))""")
def p10(spark, sf_dir):
    return records.validate_entities(rows(spark, sf_dir, "documents", ENTITY), ["LANG", "WORD"]).select("doc_id", "output")


PAGE = "SELECT page_id, html AS input, url AS output FROM pages"
_IDS = r"list_distinct(regexp_extract_all({}, '\b[a-z0-9][a-z0-9.]*\.[a-z]{{2,}}/[A-Za-z0-9][A-Za-z0-9._-]*\b', 0))"


@query("p12_ungrounded", f"SELECT page_id, len(list_filter({_IDS.format('url')}, lambda x: NOT list_contains({_IDS.format('html')}, x))) AS n FROM pages")
def p12(spark, sf_dir):
    return records.ungrounded(rows(spark, sf_dir, "pages", PAGE)).select("page_id", F.size("ungrounded").cast("long").alias("n"))


@query("p13_identifiers", f"SELECT page_id, unnest({_IDS.format('url')}) AS id FROM pages")
def p13(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(T.identifiers(F.col("url"))).alias("id"))


@query("a06_ungrounded_rate", f"SELECT avg(CASE WHEN len(list_filter({_IDS.format('url')}, lambda x: NOT list_contains({_IDS.format('html')}, x))) > 0 THEN 1.0 ELSE 0.0 END) AS rate FROM pages")
def a06(spark, sf_dir):
    return records.ungrounded_rate(rows(spark, sf_dir, "pages", PAGE))


@query("p14_reference_text", "SELECT page_id, CASE WHEN instr(html, '<p>') > 0 AND instr(html, '</p>') > instr(html, '<p>') THEN substring(html, instr(html, '<p>') + 3, greatest(0, instr(html, '</p>') - instr(html, '<p>') - 3)) ELSE html END AS ref FROM pages")
def p14(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.reference_text(F.col("html"), "<p>", "</p>").alias("ref"))


@query("p15_length_filters", "SELECT doc_id, length(text) >= 80 AS corpus, length(text) >= 200 AS chunk FROM documents WHERE length(text) > 50")
def p15(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "documents").where(n > 50).select("doc_id", (n >= 80).alias("corpus"), (n >= 200).alias("chunk"))


@query("p16_confidence_band", f"SELECT event_id, CASE WHEN u >= 0.8 THEN 'high' WHEN u >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM (SELECT event_id, {UNIT_SQL} AS u FROM events)")
def p16(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.band(F.expr(UNIT)).alias("band"))


@query("p19_forbidden_claims", "SELECT doc_id, list_filter(['Idiot', 'the', 'zz'], lambda p: contains(lower(text), lower(p))) AS found FROM documents WHERE len(list_filter(['Idiot', 'the', 'zz'], lambda p: contains(lower(text), lower(p)))) > 0")
def p19(spark, sf_dir):
    found = scorecard.forbidden(F.col("text"), F.array(F.lit("Idiot"), F.lit("the"), F.lit("zz")))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("found")).where(F.size("found") > 0)


@query("p20_status_ladder", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'fail' WHEN value < 20 THEN 'partial' ELSE 'pass' END AS status FROM events")
def p20(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scorecard.status(F.col("event_id") % 7 == 0, F.coalesce(F.col("value") < 20, F.lit(False))).alias("status"))


THOUGHT = "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '<think>so</think> ok ' || text WHEN 1 THEN '<think> hm ' || role ELSE 'a</think>b</think>' || text || '<think>' END AS t FROM conversations"


@query("p34_strip_think", f"SELECT conv_id, turn, {STRIP_SQL.format("replace(string_split(t, '</think>')[-1], '<think>', '')")} AS answer FROM ({THOUGHT})")
def p34(spark, sf_dir):
    return rows(spark, sf_dir, "conversations", THOUGHT).select("conv_id", "turn", T.strip_think(F.col("t")).alias("answer"))


@query("p38_html_escape", """SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS h FROM pages""")
def p38(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_escape(F.col("html")).alias("h"))


@query("p40_snake_words", "SELECT event_id, unnest(list_distinct(regexp_extract_all(lower(event_type || ' a_b X_Y a_b ' || event_type || '_z'), '\\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\\b', 0))) AS w FROM events")
def p40(spark, sf_dir):
    df = rows(spark, sf_dir, "events", "SELECT event_id, event_type || ' a_b X_Y a_b ' || event_type || '_z' AS t FROM events")
    return df.select("event_id", F.explode(T.snake_words(F.col("t"))).alias("w"))


@query("f15_slug", "SELECT page_id, list_extract(string_split(regexp_replace(url, '/+$', ''), '/'), -1) AS slug FROM pages")
def f15(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("f16_truncated", "SELECT doc_id, CASE WHEN length(text) > 60 THEN substring(replace(text, chr(10), ' '), 1, 60) || '...' ELSE replace(text, chr(10), ' ') END AS t FROM documents")
def f16(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncated(F.col("text"), 60).alias("t"))


NAMED_MODEL = """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'm-1.7B' WHEN 1 THEN 'm-13b-it' WHEN 2 THEN 'M70B' WHEN 3 THEN 'none' WHEN 4 THEN 'm-0.5b'
    WHEN 5 THEN 'x0.6b' WHEN 6 THEN 'a-1.5B-b' WHEN 7 THEN 'q-' || CAST(event_id % 100 AS VARCHAR(9)) || 'b' ELSE event_type END AS m FROM events"""
_HINTS = " ".join(f"WHEN contains(lower(m), '{hint}') THEN {size}" for hint, size in T.SIZE_HINTS)


@query("f17_model_size", f"SELECT event_id, CAST(CASE {_HINTS} ELSE 7 END AS INTEGER) AS size FROM ({NAMED_MODEL})")
def f17(spark, sf_dir):
    return rows(spark, sf_dir, "events", NAMED_MODEL).select("event_id", T.model_size(F.col("m")).alias("size"))


AMOUNT = """SELECT event_id, CAST(event_id % 50 AS VARCHAR(9)) || CASE event_id % 9 WHEN 0 THEN 'm' WHEN 1 THEN 'Gi' WHEN 2 THEN '' WHEN 3 THEN 'xx' WHEN 4 THEN '.5k'
    WHEN 5 THEN 'u' WHEN 6 THEN 'Ei' WHEN 7 THEN ' Mi' ELSE 'P ' END AS t FROM events"""


@query("q07_quantity", rf"""
    WITH p AS (SELECT event_id, regexp_extract({STRIP_SQL.format('t')}, '^([+-]?[0-9]*\.?[0-9]+)([A-Za-z]*)$', ['n', 's']) AS r FROM ({AMOUNT}))
    SELECT event_id, TRY_CAST(r.n AS DOUBLE) * CASE r.s WHEN '' THEN 1.0 WHEN 'n' THEN 1e-9 WHEN 'u' THEN 1e-6 WHEN 'm' THEN 1e-3 WHEN 'k' THEN 1e3 WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6
        WHEN 'G' THEN 1e9 WHEN 'T' THEN 1e12 WHEN 'P' THEN 1e15 WHEN 'E' THEN 1e18 WHEN 'Ki' THEN pow(2, 10) WHEN 'Mi' THEN pow(2, 20) WHEN 'Gi' THEN pow(2, 30) WHEN 'Ti' THEN pow(2, 40)
        WHEN 'Pi' THEN pow(2, 50) WHEN 'Ei' THEN pow(2, 60) END AS q FROM p""")
def q07(spark, sf_dir):
    return rows(spark, sf_dir, "events", AMOUNT).select("event_id", T.quantity(F.col("t")).alias("q"))


#: Replies with and without a fence, with lines that are no records and text after the fence.
REPLY = """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Here:' WHEN 1 THEN '```json' ELSE '```' END || chr(10) || '{"input":" ' || event_type || '","output":"' || CAST(user_id AS VARCHAR(9)) || '"}' || chr(10)
    || '{bad' || chr(10) || '{"input":"","output":"x"}' || chr(10) || '{"input":"y","output":null}' || chr(10) || '  {"instruction":"i","input":"' || event_type || '","output":"' || event_type || ' "}' || chr(10)
    || CASE event_id % 3 WHEN 0 THEN '' ELSE '```' || chr(10) || '{"input":"after","output":"fence"}' END AS response FROM events"""


@query("s05_parse_responses", f"""
    WITH b AS (SELECT event_id, CASE WHEN starts_with(response, '```') THEN string_split(response, '```')[2] ELSE response END AS t FROM ({REPLY})),
    c AS (SELECT event_id, string_split(CASE WHEN starts_with(t, 'json') THEN substring(t, instr(t, chr(10)) + 1) ELSE t END, chr(10)) AS l FROM b),
    u AS (SELECT event_id, unnest(l) AS line, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no FROM c),
    j AS (SELECT event_id, line_no, CASE WHEN json_valid(line) THEN CAST(line AS JSON) END AS j FROM u WHERE starts_with(trim(line), '{{'))
    SELECT event_id, line_no, trim(coalesce(json_extract_string(j, '$.instruction'), '')) AS instruction, trim(json_extract_string(j, '$.input')) AS input, trim(json_extract_string(j, '$.output')) AS output
    FROM j WHERE length(json_extract_string(j, '$.input')) > 0 AND json_extract_string(j, '$.output') IS NOT NULL""")
def s05(spark, sf_dir):
    return records.parse_responses(rows(spark, sf_dir, "events", REPLY))


# ---------------------------------------------------------------- profiles


@query("a01_label_profile", "SELECT lang AS label, count(*) AS n, count(*) / (SELECT count(*) FROM documents) AS pct, count(*) < 150 AS low FROM documents GROUP BY lang")
def a01(spark, sf_dir):
    return profile.label_profile(table(spark, sf_dir, "documents"), "lang", 150)


@query("j03_label_gaps", "SELECT 'it' AS label, 'missing' AS side UNION ALL SELECT DISTINCT lang, 'unexpected' FROM documents WHERE lang NOT IN ('en', 'de', 'fr', 'it')")
def j03(spark, sf_dir):
    return profile.label_gaps(table(spark, sf_dir, "documents"), ["EN", "de", "fr", "It"], "lang")


@query("a03_score_histogram", f"""
    WITH s AS (SELECT {UNIT_SQL} * 0.7 AS u FROM events), m AS (SELECT avg(u) AS mean FROM s),
    b AS (SELECT CASE WHEN u < 0.2 THEN 0 WHEN u < 0.4 THEN 1 WHEN u < 0.6 THEN 2 WHEN u < 0.8 THEN 3 ELSE 4 END AS k, count(*) AS c FROM s GROUP BY 1)
    SELECT CAST(r.k AS INTEGER) AS bucket, coalesce(b.c, 0) AS n, round(m.mean, 9) AS mean FROM range(0, 5) AS r(k) LEFT JOIN b ON b.k = r.k CROSS JOIN m""")
def a03(spark, sf_dir):
    return profile.score_histogram(table(spark, sf_dir, "events").select(F.expr(f"{UNIT} * 0.7D").alias("score"))).withColumn("mean", F.round("mean", 9))


@query("a04_entity_coverage", "SELECT 'LANG' AS type, count(*) AS n FROM documents UNION ALL SELECT 'NONE', count(*) FROM documents UNION ALL SELECT 'WORD', count(*) FROM documents WHERE trim(split_part(text, ' ', 1)) <> ''")
def a04(spark, sf_dir):
    return profile.entity_coverage(rows(spark, sf_dir, "documents", ENTITY))


@query("a05_output_stats", """
    WITH t AS (SELECT length(text) // 4 AS t, row_number() OVER (ORDER BY length(text) // 4) AS r, count(*) OVER () AS n FROM documents WHERE length(trim(text)) > 0)
    SELECT max(t) AS max_output_tokens, CAST(round_even(sum(t) / max(n), 0) AS BIGINT) AS avg_output_tokens, min(CASE WHEN r > floor(n * 0.95) THEN t END) AS p95_output_tokens, max(n) AS sample_count FROM t""")
def a05(spark, sf_dir):
    return records.output_stats(table(spark, sf_dir, "documents").select(F.col("text").alias("output")))


@query("a07_dataset_profile", "SELECT CAST(sum(CASE WHEN doc_id % 10 < 9 THEN 1 ELSE 0 END) AS BIGINT) AS train, CAST(sum(CASE WHEN doc_id % 10 < 9 THEN 0 ELSE 1 END) AS BIGINT) AS eval, count(*) AS total, count(DISTINCT lang) AS classes FROM documents")
def a07(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return profile.dataset_profile(docs.where("doc_id % 10 < 9"), docs.where("doc_id % 10 >= 9"), "lang")


TIMED = "SELECT event_type, value * 1.03713 AS latency_ms, value * 0.21317 - 3 AS ttft_ms, CASE WHEN event_id % 3 = 0 THEN 0 ELSE value * 0.01931 END AS itl_ms, CASE WHEN event_type = 'click' THEN -1 ELSE value * 0.71717 END AS tok_s FROM events"
_AT = "round_even(min(CASE WHEN {0}_i = least(floor({0}_c * {1}), {0}_c - 1) THEN {0} END), 1)"
_RANKED = "row_number() OVER (PARTITION BY event_type, {0} > 0 ORDER BY {0}) - 1 AS {0}_r, count(*) FILTER (WHERE {0} > 0) OVER (PARTITION BY event_type) AS {0}_c"


@query("a09_latency_summary", f"""
    WITH t AS ({TIMED}), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY latency_ms) - 1 AS latency_ms_i, count(*) OVER (PARTITION BY event_type) AS latency_ms_c,
        {_RANKED.format('ttft_ms')}, {_RANKED.format('itl_ms')} FROM t WHERE latency_ms IS NOT NULL),
    s AS (SELECT *, CASE WHEN ttft_ms > 0 THEN ttft_ms_r END AS ttft_ms_i, CASE WHEN itl_ms > 0 THEN itl_ms_r END AS itl_ms_i FROM r)
    SELECT event_type, count(*) AS n, round_even(avg(latency_ms), 1) AS avg, round_even(min(latency_ms), 1) AS min, round_even(max(latency_ms), 1) AS max, coalesce(round_even(avg(CASE WHEN tok_s > 0 THEN tok_s END), 1), 0) AS tok_s_avg,
        {_AT.format('latency_ms', 0.5)} AS p50, {_AT.format('latency_ms', 0.95)} AS p95, {_AT.format('latency_ms', 0.99)} AS p99,
        coalesce({_AT.format('ttft_ms', 0.5)}, 0) AS ttft_p50, coalesce({_AT.format('ttft_ms', 0.95)}, 0) AS ttft_p95, coalesce({_AT.format('itl_ms', 0.5)}, 0) AS itl_p50, coalesce({_AT.format('itl_ms', 0.95)}, 0) AS itl_p95
    FROM s GROUP BY event_type""")
def a09(spark, sf_dir):
    return metrics.latency_summary(rows(spark, sf_dir, "events", TIMED), ["event_type"])


@query("a11_accuracy", f"SELECT CAST(sum(CASE WHEN gold = predicted THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total, avg(CASE WHEN gold = predicted THEN 1.0 ELSE 0.0 END) AS accuracy FROM ({PREDICTED})")
def a11(spark, sf_dir):
    return metrics.accuracy(rows(spark, sf_dir, "documents", PREDICTED))


_CLASS = f"""WITH p AS ({PREDICTED}), g AS (SELECT gold AS label, count(*) AS support, sum(CASE WHEN gold = predicted THEN 1 ELSE 0 END) AS tp FROM p GROUP BY gold),
    c AS (SELECT predicted AS label, count(*) AS claimed FROM p GROUP BY predicted)
    SELECT g.label AS label, round(coalesce(tp / nullif(coalesce(claimed, 0), 0), 0), 9) AS precision, round(tp / support, 9) AS recall, round(2 * tp / (support + coalesce(claimed, 0)), 9) AS f1, support FROM g LEFT JOIN c ON g.label = c.label"""


@query("a12_per_class", _CLASS)
def a12(spark, sf_dir):
    out = metrics.per_class(rows(spark, sf_dir, "documents", PREDICTED))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("o05_weakest", _CLASS + " ORDER BY f1, g.label LIMIT 2")
def o05(spark, sf_dir):
    return profile.weakest(a12(spark, sf_dir), "f1", "label", 2)


@query("a13_regression", f"""
    WITH c AS (SELECT {UNIT_SQL} AS y, least(0.9, greatest(0.1, {UNIT_SQL} * 0.8 + 0.05)) AS p FROM events)
    SELECT round(avg(abs(y - p)), 9) AS mae, round(sqrt(avg((y - p) * (y - p))), 9) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 9) AS r2, round(corr(y, p), 9) AS pearson, round(avg(abs(y - 0.4)), 9) AS baseline_mae FROM c""")
def a13(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.expr(UNIT).alias("y"), F.expr(f"{UNIT} * 0.8D + 0.05D").alias("p"))
    out = metrics.regression(df, "y", "p", 0.1, 0.9, 0.4)
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query("a17_majority_status", f"""
    WITH s AS (SELECT user_id, {STATUS} AS status, count(*) AS n FROM events GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, CASE status WHEN 'error' THEN 0 WHEN 'fail' THEN 1 WHEN 'partial' THEN 2 ELSE 3 END) AS k FROM s)
    SELECT user_id, status, n FROM r WHERE k = 1""")
def a17(spark, sf_dir):
    return profile.majority_status(table(spark, sf_dir, "events").withColumn("status", F.expr(STATUS)), "user_id", "status")


@query("a18_status_counts", f"SELECT user_id, count(*) AS runs, CAST(sum(CASE WHEN {STATUS} = 'pass' THEN 1 ELSE 0 END) AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR) AS pass_rate FROM events GROUP BY user_id")
def a18(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("status", F.expr(STATUS))
    return df.groupBy("user_id").agg(F.count("*").alias("runs"), F.concat(F.count_if(F.col("status") == "pass").cast("string"), F.lit("/"), F.count("*").cast("string")).alias("pass_rate"))


@query("a21_first_last_min", "SELECT event_type, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, min(value) AS least FROM events GROUP BY event_type")
def a21(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min_by("value", "event_id").alias("first"), F.max_by("value", "event_id").alias("last"), F.min("value").alias("least"))


@query("a22_first_seen", "SELECT lang, arg_min(source, doc_id) AS source FROM documents GROUP BY lang")
def a22(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.min_by("source", "doc_id").alias("source"))


@query("a24_class_weights", "SELECT lang AS label, round((SELECT count(*) FROM documents) / ((SELECT count(DISTINCT lang) FROM documents) * count(*)), 9) AS weight FROM documents GROUP BY lang")
def a24(spark, sf_dir):
    return profile.class_weights(table(spark, sf_dir, "documents"), "lang").withColumn("weight", F.round("weight", 9))


@query("a25_category_accuracy", f"SELECT gold AS category, count(*) AS total, CAST(sum(CASE WHEN gold = predicted THEN 1 ELSE 0 END) AS BIGINT) AS correct, round(avg(CASE WHEN gold = predicted THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM ({PREDICTED}) GROUP BY gold HAVING count(*) >= 2")
def a25(spark, sf_dir):
    right = (F.col("gold") == F.col("predicted")).cast("long")
    return rows(spark, sf_dir, "documents", PREDICTED).groupBy(F.col("gold").alias("category")).agg(F.count("*").alias("total"), F.sum(right).alias("correct"), F.round(F.avg(right), 9).alias("accuracy")).where("total >= 2")


# ---------------------------------------------------------------- joins, windows, sets


@query("j01_gold_index", "SELECT d.doc_id AS query_id, m.gold FROM documents d JOIN (SELECT text, max(doc_id) AS gold FROM documents GROUP BY text) m ON m.text = d.text")
def j01(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return retrieve.gold_index(docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("positive")), docs.select(F.col("doc_id").alias("idx"), "text"))


@query("j02_missing_positives", "SELECT DISTINCT text FROM benchmark WHERE text NOT IN (SELECT text FROM documents)")
def j02(spark, sf_dir):
    return retrieve.missing_positives(table(spark, sf_dir, "benchmark").select(F.col("text").alias("positive")), table(spark, sf_dir, "documents"))


_DOT = "list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[]))"


@query("m08_knn_top10", f"""
    WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, {_DOT} AS s FROM embeddings q CROSS JOIN embeddings d WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM s)
    SELECT query_id, doc_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def m08(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return retrieve.knn(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), 10).withColumn("score", F.round("score", 6))


@query("a15_retrieval_eval", f"""
    WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, q.label = d.label AS hit, {_DOT} AS s FROM embeddings q CROSS JOIN embeddings d WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM s),
    b AS (SELECT query_id, min(CASE WHEN hit AND rank <= 10 THEN rank END) AS r FROM r GROUP BY query_id)
    SELECT round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 9) AS recall_1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 9) AS recall_5, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END), 9) AS recall_10, round(avg(coalesce(1.0 / r, 0)), 9) AS mrr, count(*) AS queries FROM b""")
def a15(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    found = retrieve.knn(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), 11)
    label = e.select("vec_id", "label")
    both = found.where("query_id <> doc_id").join(label.toDF("query_id", "ql"), "query_id").join(label.toDF("doc_id", "dl"), "doc_id")
    own = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    ranked = both.withColumn("r", own).where("r <= 10").withColumn("hit", F.col("ql") == F.col("dl"))
    out = metrics.retrieval_metrics(ranked, "query_id", "r", "hit")
    return out.select(*(F.round(c, 9).alias(c) if c != "queries" else c for c in out.columns))


_TERMS = r"SELECT {0}, term, count(*) AS tf FROM (SELECT {0}, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+', 0)) AS term FROM {1}) GROUP BY 1, 2"


@query("m09_bm25_top10", f"""
    WITH q AS ({_TERMS.format('item_id', 'benchmark')}), d AS ({_TERMS.format('doc_id', 'documents')}),
    l AS (SELECT doc_id, sum(tf) AS len FROM d GROUP BY doc_id), n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM l) / (SELECT count(*) FROM documents) AS a),
    f AS (SELECT term, count(*) AS df FROM d GROUP BY term),
    s AS (SELECT q.item_id AS query_id, d.doc_id, sum(ln(1 + (n.n - f.df + 0.5) / (f.df + 0.5)) * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * l.len / n.a))) AS s
          FROM q JOIN d ON d.term = q.term JOIN l ON l.doc_id = d.doc_id JOIN f ON f.term = d.term CROSS JOIN n GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM s)
    SELECT query_id, doc_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def m09(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieve.bm25(q, table(spark, sf_dir, "documents"), 10).withColumn("score", F.round("score", 6))


@query("s13_indexed_bm25", ORACLES["m09_bm25_top10"])
def s13(spark, sf_dir):
    """The same search over an index that is written, in parts by language, and written again where a part changed."""
    docs, path = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    for lang in sorted(r["lang"] or "" for r in docs.select("lang").distinct().collect()):
        mine = docs.where(F.coalesce("lang", F.lit("")) == lang)
        lexical_index.write_part(mine, path, f"lang-{lang}")
    lexical_index.write_part(docs.where(F.coalesce("lang", F.lit("")) == lang), path, f"lang-{lang}")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return lexical_index.search(spark, path, q, 10).withColumn("score", F.round("score", 6))


_LISTS = "SELECT user_id AS query_id, event_id % 4 AS list, event_id % 97 AS doc_id, row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY event_id) AS rank FROM events"


@query("w10_interleave", f"""
    WITH l AS ({_LISTS}), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank, list) AS k FROM l),
    p AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, list) AS place FROM f WHERE k = 1)
    SELECT query_id, doc_id, CAST(place AS INTEGER) AS place FROM p WHERE place <= 18""")
def w10(spark, sf_dir):
    return retrieve.interleave(rows(spark, sf_dir, "events", _LISTS), 18)


@query("u02_hybrid", f"""
    WITH l AS (SELECT query_id, doc_id, min(list * 100000 + rank) AS o FROM ({_LISTS}) WHERE list < 2 GROUP BY 1, 2)
    SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o) AS INTEGER) AS place FROM l""")
def u02(spark, sf_dir):
    lists = rows(spark, sf_dir, "events", _LISTS)
    return retrieve.hybrid(lists.where("list = 0"), lists.where("list = 1"), None, None)


@query("j10_entity_metrics", """
    WITH g AS (SELECT DISTINCT doc_id, lang AS type, source AS text FROM documents), p AS (SELECT DISTINCT doc_id, lang AS type, CASE WHEN doc_id % 5 = 0 THEN 'src0' ELSE source END AS text FROM documents),
    b AS (SELECT coalesce(g.type, p.type) AS type, CASE WHEN g.doc_id IS NOT NULL THEN 1 ELSE 0 END AS g, CASE WHEN p.doc_id IS NOT NULL THEN 1 ELSE 0 END AS p FROM g FULL OUTER JOIN p ON g.doc_id = p.doc_id AND g.type = p.type AND g.text = p.text),
    c AS (SELECT type, sum(g * p) AS tp, sum((1 - g) * p) AS fp, sum(g * (1 - p)) AS fn FROM b GROUP BY type UNION ALL SELECT NULL, sum(g * p), sum((1 - g) * p), sum(g * (1 - p)) FROM b)
    SELECT type, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""")
def j10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = metrics.entity_metrics(docs.select("doc_id", F.col("lang").alias("type"), F.col("source").alias("text")), docs.select("doc_id", F.col("lang").alias("type"), F.when(F.col("doc_id") % 5 == 0, "src0").otherwise(F.col("source")).alias("text")))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("j13_diff_baseline", f"""
    WITH n AS (SELECT event_id AS id, {STATUS} AS status FROM events), b AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'partial' ELSE {STATUS} END AS was FROM events WHERE event_id % 2 = 0),
    j AS (SELECT n.id, status, was, CASE status WHEN 'partial' THEN 1 WHEN 'pass' THEN 2 ELSE 0 END - CASE was WHEN 'partial' THEN 1 WHEN 'pass' THEN 2 ELSE 0 END AS d FROM n JOIN b ON b.id = n.id)
    SELECT id, status, was, CASE WHEN d < 0 THEN 'regression' ELSE 'improvement' END AS change FROM j WHERE d <> 0""")
def j13(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr(STATUS).alias("status"))
    return scorecard.diff_baseline(e, e.where("id % 2 = 0").withColumn("status", F.when(F.col("id") % 3 == 0, "partial").otherwise(F.col("status"))))


@query("w04_keep_first", "SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def w04(spark, sf_dir):
    return records.keep_first(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], ["doc_id"])


@query("w05_split", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor((SELECT count(*) FROM documents) * 0.9) THEN 'train' ELSE 'eval' END AS split FROM documents")
def w05(spark, sf_dir):
    return records.split_positional(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


@query("w07_plan_batches", """
    WITH p AS (SELECT 103 AS target, 5 AS size, 0.2 AS share), c AS (SELECT *, CAST(ceil(target / size) AS BIGINT) AS batches FROM p)
    SELECT k AS batch, CAST(least(size, target - k * size) AS BIGINT) AS n, k < round_even(batches * share, 0) AS abstain FROM c, range(0, batches) AS t(k)""")
def w07(spark, sf_dir):
    return records.plan_batches(spark, 103, 5, 0.2)


@query("w08_last_rows", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 10")
def w08(spark, sf_dir):
    return records.last_rows(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 10)


@query("u05_distinct_sorted", "SELECT DISTINCT text FROM documents")
def u05(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("text").distinct().orderBy("text")


@query("u07_ordered_distinct", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || ',' || source ELSE source || ',' || lang END AS labels FROM documents")
def u07(spark, sf_dir):
    df = rows(spark, sf_dir, "documents", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN array(lang, ' ', source, concat(lang, ' ')) ELSE array(source, lang, source) END AS a FROM documents")
    return df.select("doc_id", F.array_join(T.ordered_distinct(F.col("a")), ",").alias("labels"))


# ---------------------------------------------------------------- tokens and tags


@query("f02_tokens", r"""
    SELECT doc_id, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[-./][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]', 0)) AS t FROM documents) GROUP BY doc_id""")
def f02(spark, sf_dir):
    t = tagger.tokens(table(spark, sf_dir, "documents"), "doc_id")
    return t.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("tok")).alias("chars"))


#: Tokens with their offsets: gaps and tokens alternate, so running sums of both are the ends.
OFFSETS_SQL = """
    l AS (SELECT {key}, text, regexp_extract_all(text, '{token}', 0) AS toks, regexp_split_to_array(text, '{token}') AS gaps FROM {table}),
    u AS (SELECT {key}, text, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i, gaps FROM l),
    o AS (SELECT {key}, text, CAST(i - 1 AS INTEGER) AS pos, tok, CAST(sum(length(tok) + length(gaps[i])) OVER (PARTITION BY {key} ORDER BY i) AS INTEGER) AS e FROM u),
    toks AS (SELECT {key}, text, pos, tok, CAST(e - length(tok) AS INTEGER) AS s, e FROM o)"""


@query("f02_token_offsets", f"WITH {OFFSETS_SQL.format(key='doc_id', token=TOKEN_SQL, table='documents')} SELECT doc_id, CAST(sum(s) AS BIGINT) AS s, CAST(sum(e * (pos + 1)) AS BIGINT) AS e, count(*) AS n FROM toks GROUP BY doc_id")
def f02_offsets(spark, sf_dir):
    t = tagger.tokens(table(spark, sf_dir, "documents"), "doc_id")
    return t.groupBy("doc_id").agg(F.sum("s").alias("s"), F.sum(F.col("e").cast("long") * (F.col("pos") + 1)).alias("e"), F.count("*").alias("n"))


TAG = "CASE (event_id * event_id + event_id % 7) % 5 WHEN 0 THEN 'B-X' WHEN 1 THEN 'I-X' WHEN 2 THEN 'I-Y' WHEN 3 THEN 'O' ELSE 'B-Y' END"


@query("w03_decode_bio", f"""
    WITH t AS (SELECT user_id, event_id AS pos, {TAG} AS tag FROM events), s AS (SELECT *, sum(CASE WHEN tag LIKE 'B-%' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS seg FROM t),
    k AS (SELECT *, first_value(substring(tag, 3)) OVER (PARTITION BY user_id, seg ORDER BY pos) AS type FROM s WHERE seg > 0),
    o AS (SELECT *, min(CASE WHEN tag LIKE 'B-%' OR tag = 'I-' || type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, seg ORDER BY pos) AS ok FROM k)
    SELECT user_id, type, min(pos) AS s, max(pos + 1) AS e FROM o WHERE ok = 1 GROUP BY user_id, seg, type""")
def w03(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), F.expr(TAG).alias("tag"), F.col("event_id").alias("s"), (F.col("event_id") + 1).alias("e"))
    return tagger.decode_bio(df, "user_id")


_SHAPE = r"substring(regexp_replace(regexp_replace(regexp_replace({0}, '\p{{Ll}}', 'x', 'g'), '\p{{Lu}}', 'X', 'g'), '\p{{Nd}}', 'd', 'g'), 1, 8)"
_NEAR = {f"{name}{k:+d}": f"{'lag' if k < 0 else 'lead'}({expr}, {abs(k)}) OVER w" for k in (-2, -1, 1, 2) for name, expr in (("w", "lower(tok)"), ("shape", _SHAPE.format("tok")))}
_TEXTS = {"w": "lower(tok)", "shape": _SHAPE.format("tok"), "pre2": "left(lower(tok), 2)", "pre3": "left(lower(tok), 3)", "suf2": "right(lower(tok), 2)", "suf3": "right(lower(tok), 3)"} | _NEAR
_FLAGS = {
    "title": r"regexp_matches(tok, '\p{L}') AND len(list_filter(regexp_extract_all(tok, '\p{L}+'), lambda x: NOT regexp_matches(x, '^\p{Lu}\p{Ll}*$'))) = 0",
    "upper": "length(tok) > 1 AND upper(tok) = tok AND lower(tok) <> tok", "hasdig": r"regexp_matches(tok, '\p{Nd}')", "alldig": r"regexp_matches(tok, '^\p{Nd}+$')", "hashyf": "contains(tok, '-')",
    "hasdot": "contains(tok, '.')", "punct": r"NOT regexp_matches(tok, '[\p{L}\p{N}]')", "bias": "true", "BOS": "pos = 0", "EOS": "lead(pos) OVER w IS NULL",
}
_EDGES = ("BOS", "EOS")
#: (item_id, pos, feature, value) of the benchmark's tokens.
FEATURES_SQL = f"""{OFFSETS_SQL.format(key='item_id', token=TOKEN_SQL, table='benchmark')},
    wide AS (SELECT item_id, pos, {', '.join(f'{e} AS "{n}"' for n, e in _TEXTS.items())}, {', '.join(f'{e} AS "{n}"' for n, e in _FLAGS.items())} FROM toks WINDOW w AS (PARTITION BY item_id ORDER BY pos)),
    facts AS ({' UNION ALL '.join([f"""SELECT item_id, pos, '{n}=' || "{n}" AS feature, CAST(1 AS DOUBLE) AS value FROM wide WHERE "{n}" IS NOT NULL""" for n in _TEXTS] + [f"""SELECT item_id, pos, '{n}', CAST("{n}" AS DOUBLE) FROM wide{f' WHERE "{n}"' if n in _EDGES else ''}""" for n in _FLAGS])})"""


def item_tokens(spark, sf_dir):
    return tagger.tokens(table(spark, sf_dir, "benchmark"), "item_id")


@query("m13_token_features", f"WITH {FEATURES_SQL} SELECT item_id, pos, feature, value FROM facts")
def m13(spark, sf_dir):
    return tagger.feature_rows(tagger.features(item_tokens(spark, sf_dir), "item_id"), "item_id")


@query("f03_shape", f"WITH {OFFSETS_SQL.format(key='item_id', token=TOKEN_SQL, table='benchmark')} SELECT item_id, pos, {_SHAPE.format('tok')} AS shape FROM toks")
def f03(spark, sf_dir):
    return item_tokens(spark, sf_dir).select("item_id", "pos", T.shape(F.col("tok")).alias("shape"))


@query("f05_flags", f"WITH {FEATURES_SQL} SELECT feature, CAST(sum(value) AS BIGINT) AS n FROM facts WHERE feature IN ({', '.join(repr(n) for n in _FLAGS)}) GROUP BY feature")
def f05(spark, sf_dir):
    return m13(spark, sf_dir).where(F.col("feature").isin(list(_FLAGS))).groupBy("feature").agg(F.sum("value").cast("long").alias("n"))


#: A vocabulary of surfaces; one stands inside longer words too.
VOCABULARY = (("F", "the"), ("F", "with"), ("G", "que"), ("G", "th"))
_SPANS_SQL = f"""
    surfaces AS (SELECT * FROM (VALUES {', '.join(map(str, VOCABULARY))}) AS v(type, surface)),
    cuts AS (SELECT d.doc_id, type, surface, string_split(d.text, surface) AS p FROM documents d JOIN surfaces ON contains(d.text, surface)),
    gaps AS (SELECT doc_id, type, surface, unnest(p[:-2]) AS gap, generate_subscripts(p[:-2], 1) AS k FROM cuts),
    ends AS (SELECT doc_id, type, surface, CAST(sum(length(gap) + length(surface)) OVER (PARTITION BY doc_id, type, surface ORDER BY k) AS INTEGER) AS ge FROM gaps),
    spans AS (SELECT doc_id, type, surface, CAST(ge - length(surface) AS INTEGER) AS gs, ge FROM ends)"""


def vocabulary(spark):
    return spark.createDataFrame(list(VOCABULARY), "type string, surface string")


@query("j07_find_spans", f"WITH {_SPANS_SQL} SELECT doc_id, type, surface, gs, ge FROM spans")
def j07(spark, sf_dir):
    return tagger.find_spans(table(spark, sf_dir, "documents"), vocabulary(spark), "doc_id").drop("ord")


@query("m14_bio_tags", f"""
    WITH {OFFSETS_SQL.format(key='doc_id', token=TOKEN_SQL, table='documents')}, {_SPANS_SQL},
    hit AS (SELECT t.doc_id, t.pos, min(CAST(t.s AS BIGINT)) AS s, min(struct_pack(type := p.type, gs := p.gs)) AS m FROM toks t JOIN spans p ON p.doc_id = t.doc_id AND t.s < p.ge AND t.e > p.gs GROUP BY 1, 2),
    tags AS (SELECT t.doc_id, CASE WHEN h.m IS NULL THEN 'O' WHEN t.s <= h.m.gs THEN 'B-' || h.m.type ELSE 'I-' || h.m.type END AS tag FROM toks t LEFT JOIN hit h ON h.doc_id = t.doc_id AND h.pos = t.pos)
    SELECT doc_id, tag, count(*) AS n FROM tags GROUP BY 1, 2""")
def m14(spark, sf_dir):
    tagged = tagger.tag_texts(table(spark, sf_dir, "documents"), vocabulary(spark), "doc_id")
    tag = F.when(F.col("doc_id").isNull(), "O").otherwise(F.col("tag")).alias("tag")  # in the SQL, spans meet tokens by doc_id
    return tagged.groupBy("doc_id", tag).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- events, pages, capacity


@query("st1_fold_events", """
    WITH e AS (SELECT user_id AS run_id, event_id AS seq, CASE event_id % 9 WHEN 0 THEN 'answer_reset' WHEN 1 THEN 'model' ELSE 'token' END AS type, event_type AS text FROM events),
    r AS (SELECT *, coalesce(max(CASE WHEN type = 'answer_reset' THEN seq END) OVER (PARTITION BY run_id), -1) AS reset FROM e)
    SELECT run_id, coalesce(string_agg(CASE WHEN type = 'token' AND seq > reset THEN text END, '' ORDER BY seq), '') AS answer, arg_max(CASE WHEN type = 'model' THEN text END, CASE WHEN type = 'model' THEN seq END) AS model, count(*) AS n FROM r GROUP BY run_id""")
def st1(spark, sf_dir):
    df = rows(spark, sf_dir, "events", "SELECT user_id AS run_id, event_id AS seq, CASE event_id % 9 WHEN 0 THEN 'answer_reset' WHEN 1 THEN 'model' ELSE 'token' END AS type, event_type AS text FROM events")
    return scorecard.fold_events(df)


@query("st1_fold_stream", ORACLES["st1_fold_events"])
def st1_stream(spark, sf_dir):
    """The same fold by a stream over the events, with its state and its versions in the shared folder."""
    held = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may name a file
    kind = F.when(F.col("event_id") % 9 == 0, "answer_reset").when(F.col("event_id") % 9 == 1, "model").otherwise("token")
    events = held.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.col("event_type").alias("text"), "ts")
    path = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    runs.fold_to(events, f"{path}/out", f"{path}/state").awaitTermination()
    return runs.folded(spark, f"{path}/out").select("run_id", "answer", "model", "n")


@query("s08_html_text")
def s08(spark, sf_dir):
    return files.html_to_text(table(spark, sf_dir, "pages")).select("page_id", F.length("text").alias("n_chars"), T.slug(F.col("url")).alias("slug"))


LINES = """SELECT user_id, CASE event_id % 4 WHEN 0 THEN 'data: {bad' WHEN 1 THEN 'data: {"type":"token","text":"' || event_type || '"}' WHEN 2 THEN 'event: x' ELSE 'data: [DONE]' END AS value FROM events"""


@query("s17_sse", f"""
    WITH d AS (SELECT user_id, substring(value, 7) AS d FROM ({LINES}) WHERE starts_with(value, 'data: ')),
    e AS (SELECT user_id, CASE WHEN d = '[DONE]' THEN 'done' WHEN json_valid(d) THEN json_extract_string(d, '$.type') END AS type, CASE WHEN json_valid(d) THEN json_extract_string(d, '$.text') END AS text FROM d)
    SELECT user_id, type, text, count(*) AS n FROM e WHERE type IS NOT NULL GROUP BY 1, 2, 3""")
def s17(spark, sf_dir):
    return files.read_sse(rows(spark, sf_dir, "events", LINES)).groupBy("user_id", "type", "text").agg(F.count("*").alias("n"))


@query("q01_cost_tiers", """
    WITH p AS (SELECT 273.0 AS ms, 0.0821 AS cpu, 0.3341 AS gpu), d AS (SELECT unnest([1000, 10000, 100000, 1000000]) AS daily),
    r AS (SELECT *, CAST(greatest(1, ceil(daily / 86400.0 / (1000 / ms))) AS BIGINT) AS c, CAST(greatest(1, ceil(daily / 86400.0 / (15 * 1000 / ms))) AS BIGINT) AS g FROM d, p)
    SELECT CAST(daily AS BIGINT) AS daily, CAST(round_even(CAST(daily AS DOUBLE) / 86400, 2) AS DOUBLE) AS rps_needed, c AS cpu_replicas,
        CAST(round_even(round_even(round_even(CAST(cpu AS DOUBLE) * 2.5, 3) * 730, 2) * c, 2) AS DOUBLE) AS cpu_od, CAST(round_even(round_even(CAST(cpu AS DOUBLE) * 730, 2) * c, 2) AS DOUBLE) AS cpu_spot, g AS gpu_replicas,
        CAST(round_even(round_even(round_even(CAST(gpu AS DOUBLE) * 3, 3) * 730, 2) * g, 2) AS DOUBLE) AS gpu FROM r""")
def q01(spark, sf_dir):
    return scorecard.cost_tiers(spark.createDataFrame([(273.0,)], "avg double"), spark.createDataFrame([(0.0821, 0.3341)], "cpu double, gpu double"))


@query("q04_context_window", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN greatest(8192, 4 * (event_id % 5000)) WHEN event_id % 5000 > 0 THEN greatest(512, 3 * (event_id % 5000)) ELSE 512 END AS w FROM events")
def q04(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scorecard.context_window(F.col("event_id") % 5000, F.col("event_id") % 2 == 0).alias("w"))


@query("q05_latency_model", "SELECT event_id, round((event_id % 700) / 367.0 + (event_id % 300) * 28.0 / 1000, 9) AS s FROM events")
def q05(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(scorecard.latency(F.col("event_id") % 700, F.col("event_id") % 300, F.lit(367.0), F.lit(28.0)), 9).alias("s"))
