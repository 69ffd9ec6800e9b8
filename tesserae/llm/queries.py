"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tesserae.llm.asof_join import clicks_to_orders
from tesserae.llm.chat_format import format_conversations, read_back
from tesserae.llm.common import table
from tesserae.llm.decontamination import contamination
from tesserae.llm.embedding_dedup import near_duplicates
from tesserae.llm.fingerprints import fingerprints
from tesserae.llm.mixing import mix_sources
from tesserae.llm.ngram_join import ngram_components
from tesserae.llm.packing import pack
from tesserae.llm.quality import quality_scores
from tesserae.llm.suffix_dedup import merged_passages
from tesserae.llm.token_alignment import align_tokens
from tesserae.llm.toxicity import toxicity_scores
from tesserae.llm.url_filter import filter_urls

#: Production parameters: the tokenizer's files and what its split pattern and special token are.
BYTE_BPE = {"tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "special": ("<|endoftext|>",)}

#: Production parameters of the alignment: side A's files and split pattern, side B's file.
ALIGNED = {"tokenizer_path": BYTE_BPE["tokenizer_path"], "ranks_path": BYTE_BPE["ranks_path"], "pattern": BYTE_BPE["pattern"], "pieces_path": public_tokenizers.path("piece_bpe_32k.model")}

#: Production parameters of the packing: the first 32 tokens of a document (at most half) count as its prompt and bear no
#: loss, and a sequence has at most 64 documents and 2016 loss-bearing tokens of 2048.
PACKING = {"tokens": 2048, "segments": 64, "loss": 2016, "prompt": 32}

#: The url rules of op4's contract.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: op8's conversation -1, whose texts hold control strings.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op1_embedding_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op2_vector_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), BYTE_BPE, **PACKING)


def op3_suffix_array_dedup(spark, sf_dir):
    found = merged_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.expr("transform(spans, s -> s.lo)").alias("first_words"), F.expr("transform(spans, s -> s.hi)").alias("end_words"), F.expr("cast(aggregate(spans, 0, (a, s) -> a + s.hi - s.lo) as long)").alias("n_words"), "sources")


def op4_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op5_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"), exponent=0.5)


def op8_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], turns.schema)
    return read_back(format_conversations(turns.union(own), BYTE_BPE), BYTE_BPE)


def op9_ngram_jaccard_join(spark, sf_dir):
    return ngram_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op10_toxicity(spark, sf_dir):
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_asof_join(spark, sf_dir):
    return clicks_to_orders(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales"))


def op12_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark, sf_dir):
    return align_tokens(table(spark, sf_dir, "documents"), ALIGNED)


DEALT = (
    op1_embedding_dedup,
    op2_vector_packing,
    op3_suffix_array_dedup,
    op4_url_filter,
    op5_quality_classifier,
    op6_fingerprints,
    op7_source_mixing,
    op8_chat_format,
    op9_ngram_jaccard_join,
    op10_toxicity,
    op11_asof_join,
    op12_decontamination,
    op13_token_alignment,
)
QUERIES = {f.__name__: f for f in DEALT}
#: crc32 of an id's decimal digits, in SQL: a table of 256 values, then one step for each digit.
CRC_STEP = "CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
CRC_TABLE = f"""crc_bits AS (
            WITH RECURSIVE b(i, k, v) AS (
                SELECT i, 0, i FROM range(256) AS r(i) UNION ALL SELECT i, k + 1, {CRC_STEP} FROM b WHERE k < 8)
            SELECT list(v ORDER BY i) AS crc_t FROM b WHERE k = 8)"""


#: Words of op12 in SQL.
WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def crc_sql(ident: str) -> str:
    digits = f"list_transform(string_split(CAST({ident} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda c, d: xor(c >> 8, crc_t[CAST(xor(c, d) & 255 AS BIGINT) + 1])), 4294967295)"


ORACLES: dict[str, str] = {
    "op7_source_mixing": """
        WITH sizes AS (SELECT source, count(*) AS n, pow(count(*), 0.5) AS w FROM documents GROUP BY source),
        rates AS (SELECT source, (SELECT sum(n) FROM sizes) * w / (SELECT sum(w) FROM sizes) / n AS r FROM sizes),
        steps AS (SELECT source, k, sum(exp(-r + k * ln(r) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
                  FROM rates CROSS JOIN range(0, 400) AS t(k) WHERE k <= ceil(r + 12 * sqrt(r) + 40)),
        draws AS (SELECT d.*, CAST('0x' || substr(md5('7|' || CAST(doc_id AS VARCHAR) || '|' || md5(coalesce(text, '')) || '|0'), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents d),
        times AS (SELECT d.doc_id, count(*) AS x FROM draws d JOIN steps s ON d.source = s.source AND s.cdf <= d.u GROUP BY d.doc_id)
        SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(c.k AS INTEGER) AS "copy"
        FROM documents d JOIN times t ON d.doc_id = t.doc_id JOIN range(1, 400) AS c(k) ON c.k <= t.x""",
    "op11_asof_join": f"""
        WITH {CRC_TABLE},
        clicked AS (SELECT click_id, client_id, min(epoch_us(ts)) AS t FROM clicks GROUP BY ALL),
        hashed AS (SELECT click_id, client_id, t, {crc_sql("click_id")} AS h FROM clicked, crc_bits),
        events AS (SELECT click_id, client_id, CASE WHEN h % 2 = 1 THEN t - t % 86400000000 ELSE t END AS ts_us FROM hashed),
        sold AS (SELECT *, epoch_us(sold_at) AS t, {crc_sql("sale_id")} AS h FROM sales, crc_bits),
        used AS (SELECT client_id, sale_id, priority, CAST(floor(100 * total + 0.5) AS BIGINT) AS cents, h,
                        CASE WHEN h % 2 = 1 THEN t - t % 86400000000 ELSE t END AS at_us FROM sold WHERE client_id IS NOT NULL AND t IS NOT NULL),
        both_orders AS (SELECT client_id, at_us, sale_id, priority, cents FROM used
                        UNION ALL SELECT client_id, at_us, -1 - sale_id, 6 - priority, cents FROM used WHERE h % 3 <> 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY client_id, at_us ORDER BY priority DESC NULLS LAST, sale_id) AS r,
                          count(*) OVER (PARTITION BY client_id, at_us) AS n FROM both_orders),
        best AS (SELECT * FROM ranked WHERE r = 1)
        SELECT e.click_id, e.client_id, e.ts_us, CASE WHEN ok THEN sale_id END AS sale_id, CASE WHEN ok THEN e.ts_us - at_us END AS lag_us,
               CASE WHEN ok THEN cents END AS total_cents, CASE WHEN ok THEN n ELSE 0 END AS n_tied
        FROM (SELECT e.*, b.sale_id, b.at_us, b.cents, b.n, coalesce(e.ts_us - b.at_us <= 259200000000, false) AS ok
              FROM events e ASOF LEFT JOIN best b ON e.client_id = b.client_id AND e.ts_us >= b.at_us) e""",
    "op12_decontamination": f"""
        WITH item_words AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
        begins AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0),
        runs AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS run, len(w[i : i + 9]) AS n FROM begins),
        doc_words AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM doc_words),
        ten AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS g FROM words),
        grams AS (SELECT doc_id, i, n, array_to_string(g[1 : n], ' ') AS run FROM ten JOIN (SELECT DISTINCT n FROM runs) ON len(g) >= n),
        found AS (SELECT doc_id, i, g.n, item_id FROM grams g JOIN runs r ON g.run = r.run AND g.n = r.n),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
        named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM found GROUP BY doc_id)
        SELECT d.doc_id, coalesce(len(d.w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc_words d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN named m ON d.doc_id = m.doc_id""",
}
