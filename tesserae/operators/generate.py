"""Generation, judging and gating over pluggable backends: prompts are built as columns, backends map Arrow batches.

A backend is any object with the method its Protocol names; it is pickled to the workers. The Stub backends are
deterministic and need no network: they make the flow testable and say nothing about a model's quality.
"""

from __future__ import annotations

import functools
import hashlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.replies import gate_verdict, judge_line
from tesserae.functions.text import KNOWN_IDENTIFIERS, py_strip, strip_think
from tesserae.operators.leading import leading_text
from tesserae.operators.records import numbered, parse_responses, plan_batches, sample_n, ungrounded
from tesserae.operators.written import pieces

#: Records asked for in a prompt, characters of a source, of a reference and of a chunk in one, queries asked of a chunk.
BATCH, SAMPLE_CHARS, REFERENCE_CHARS, CHUNK_CHARS, QUERIES_A_CHUNK = 5, 500, 8_000, 4_000, 3
#: Markers of the reference and of the query in a grounded record's input.
REFERENCE, QUERY = ("<<reference>>", "<</reference>>"), ("<<query>>", "<</query>>")
#: Our own prompt texts.
PROMPTS = {
    "records": "Write {n} records as JSON lines with instruction, input and output for: {domain}\nSources:\n{samples}",
    "grounded": "Write {n} records as JSON lines answered from the reference alone, for: {domain}\n{reference}",
    "abstain": "Write {n} records as JSON lines whose question the reference does not answer and whose output says so, for: {domain}\n{reference}",
    "queries": "Write {n} queries as JSON lines with query that this passage answers, for: {domain}\n{reference}",
    "judge": "Task: {domain}\nInput: {input}\nExpected: {expected}\nPredicted: {predicted}\nReply CORRECT: why, or INCORRECT: why.",
    "gate": "Question: {query}\nAnswer: {draft}\nEvidence: {context}\nReply with a JSON object of verdict (pass or escalate) and reason.",
}


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str | None]: ...


class Judge(Protocol):
    def judge(self, prompts: list[str]) -> list[str | None]: ...


class Reranker(Protocol):
    def score(self, queries: pd.Series, texts: pd.Series) -> pd.Series: ...


@functools.lru_cache(1 << 16)
def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


class HashingEncoder:
    """Signed hashed words, L2-normalised (with 1e-12, so a text without words has zeros): the offline encoder."""

    def __init__(self, dim: int = 64, most_tokens: int = 512):
        self.dim, self.most_tokens = dim, most_tokens

    def encode(self, texts: list[str]) -> np.ndarray:
        words = [text.lower().split()[: self.most_tokens] for text in texts]
        h = np.fromiter((word_hash(w) for row in words for w in row), np.uint64)
        at = np.repeat(np.arange(len(texts)) * self.dim, [len(row) for row in words]) + (h % np.uint64(self.dim)).astype(np.int64)
        signs = np.where(h >> np.uint64(63), 1.0, -1.0)
        out = np.bincount(at, signs, len(texts) * self.dim).astype(np.float32).reshape(len(texts), self.dim)
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-12)


class StubGenerator:
    """Replies made from the prompt's hash: `n` JSON records, or queries, in a code fence now and then."""

    def __init__(self, fail_every: int = 0):
        self.fail_every = fail_every

    def generate(self, prompts: list[str]) -> list[str | None]:
        return [self.reply(p) for p in prompts]

    def reply(self, prompt: str) -> str | None:
        code = int(hashlib.blake2b(prompt.encode(), digest_size=6).hexdigest(), 16)
        if self.fail_every and code % self.fail_every == 0:
            raise RuntimeError("no reply")
        n = int(prompt.split(" ", 2)[1]) if prompt.startswith("Write ") else 1
        if "with query" in prompt:
            lines = [json.dumps({"query": f"what about {code + i:x}?"}) for i in range(n)]
        else:
            lines = [json.dumps({"instruction": "answer", "input": f"case {code + i:x}", "output": f"label{(code + i) % 4}|high"}) for i in range(n)]
        body = "\n".join(lines)
        return f"```json\n{body}\n```" if code % 3 == 0 else body


class StubJudge:
    """CORRECT where the prediction's first line holds what is expected; as a gate, pass where the evidence holds the answer."""

    def judge(self, prompts: list[str]) -> list[str | None]:
        return [self.reply(dict(line.split(": ", 1) for line in p.splitlines() if ": " in line)) for p in prompts]

    def reply(self, said: dict[str, str]) -> str:
        if "Answer" in said:
            verdict = "pass" if said["Answer"] and said["Answer"] in said.get("Evidence", "") else "escalate"
            return json.dumps({"verdict": verdict, "reason": "looked up"})
        right = said.get("Expected", "") in said.get("Predicted", "")
        return ("CORRECT" if right else "INCORRECT") + ": compared"


class OverlapReranker:
    """Cosine of two texts' sets of words: the offline scorer."""

    def score(self, queries: pd.Series, texts: pd.Series) -> pd.Series:
        def one(a: str, b: str) -> float:
            x, y = set(a.lower().split()), set(b.lower().split())
            return len(x & y) / (len(x) * len(y)) ** 0.5 if x and y else 0.0

        return pd.Series([one(a or "", b or "") for a, b in zip(queries, texts, strict=True)])


class Throttled(Exception):
    """A backend's answer to too many calls."""


def retrying(fn: Callable, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """fn with retries: waits of 2, 4, 8 s where it is throttled, else of 1 and 2 s; None where no attempt succeeds."""

    def run(*args):
        for attempt in range(attempts):
            try:
                return fn(*args)
            except Throttled:
                sleep(2 ** (attempt + 1))
            except Exception:  # whatever a backend raises
                if attempt + 1 < attempts:
                    sleep(2**attempt)
        return None

    return run


def map_backend(df: DataFrame, call: Callable[[list], list], column: str, out: str, partitions: int | None = None, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """df with `out`: the backend's reply to each row's `column`, null where every attempt failed.

    Prompts are sent in pieces of bounded rows and bytes; one that fails is tried row by row, so one bad row costs its own
    reply only. `partitions` bounds the calls at once.
    """
    rows = df.repartition(partitions) if partitions else df

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = retrying(lambda x: call([x])[0], attempts, sleep)
        for batch in batches:
            replies = []
            for lo, hi in pieces(batch):
                given = batch.slice(lo, hi - lo).to_pylist()
                try:
                    got = pa.array(list(call(given)), pa.string())
                    if len(got) != len(given):
                        raise ValueError("a reply for each prompt")
                except Exception:  # whatever a backend raises
                    got = pa.array([one(x) for x in given], pa.string())
                replies.append(got)
            yield pa.concat_arrays(replies) if replies else pa.array([], pa.string())

    return rows.withColumn(out, run(F.col(column)))


def filled(prompt: str, **values: Column) -> Column:
    """A prompt's text with columns for its fields."""
    out = F.lit(PROMPTS[prompt])
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def render_samples(samples: DataFrame, keys: list[str], order: str, source: str = "source", content: str = "content") -> DataFrame:
    """(keys, samples): the sources of each key as `[source]` and the first SAMPLE_CHARS characters, between rules."""
    one = F.concat(F.lit("["), F.coalesce(F.col(source), F.lit("unknown")), F.lit("]\n"), F.substring(F.coalesce(F.col(content), F.lit("")), 1, SAMPLE_CHARS))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, one.alias("text")))), lambda x: x["text"])
    return samples.groupBy(*keys).agg(F.array_join(listed, "\n---\n").alias("samples"))


def render_reference(chunks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, reference) of chunks(text, source, section): each under `[source / section]`, of what is known of these."""
    known = F.filter(F.array("source", "section"), lambda x: F.length(F.coalesce(x, F.lit(""))) > 0)
    header, body = F.array_join(known, " / "), py_strip(F.coalesce("text", F.lit("")))
    one = F.when(F.length(header) > 0, F.concat(F.lit("["), header, F.lit("]\n"), body)).otherwise(body)
    return leading_text(chunks, keys, order, one, "\n\n---\n\n", REFERENCE_CHARS, "reference")


def _drawn(batches: DataFrame, pool: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """(batch, place, the pool's columns): for each batch n rows of the whole pool, without replacement, by a hash.

    The pool's distinct keys are numbered; a batch draws numbers until it has n unlike ones, or takes all in the order of
    a hash where there are few. Of rows that repeat a key the first comes, in order of its text.
    """
    keys = pool.select(F.col(key).alias("drawn")).where("drawn is not null").distinct()
    at = numbered(keys, ["drawn"], "number")
    size = at.count()
    if size <= 4 * n:
        drawn = batches.select("batch", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(size).cast("long"))).alias("number")) if size else batches.select("batch", F.lit(None).cast("long").alias("number")).limit(0)
        drawn = drawn.withColumn("turn", F.xxhash64(F.lit(seed), "batch", "number"))
    else:  # each draw is a new number at three of four: with so many none runs short
        tries = batches.select("batch", F.explode(F.sequence(F.lit(0), F.lit(3 * n + 60))).alias("try"))
        number = F.pmod(F.xxhash64(F.lit(seed), "batch", "try"), F.lit(size)) + 1
        drawn = tries.groupBy("batch", number.alias("number")).agg(F.min("try").cast("long").alias("turn"))
    place = F.row_number().over(Window.partitionBy("batch").orderBy("turn", "number"))
    picked = drawn.withColumn("place", place).where(F.col("place") <= n).join(at, "number").select("batch", "place", "drawn")
    wanted = pool.join(picked.select("drawn").distinct(), F.col(key) == F.col("drawn"), "left_semi")
    rest = [c for c in pool.columns if c != key]
    single = wanted.groupBy(key).agg(F.min(F.struct(*rest)).alias("row")).select(key, "row.*")
    return picked.join(single, F.col("drawn") == F.col(key)).drop("drawn")


def generate_records(sources: DataFrame, generator: Generator, target: int, domain: str, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """(batch, line_no, instruction, input, output) from prompts with ten sampled sources(source, content) each.

    Batches of BATCH records are asked for, the last one partial; failed ones give none; the first `target` stay.
    """
    plan = plan_batches(sources.sparkSession, target, BATCH)
    samples = render_samples(_drawn(plan, sources, "source", 10, seed), ["batch"], "place")
    prompts = plan.join(samples, "batch", "left").withColumn("prompt", filled("records", n=F.col("n"), domain=F.lit(domain), samples=F.col("samples")))
    replies = map_backend(prompts.select("batch", "prompt"), generator.generate, "prompt", "response", partitions).select("batch", "response")
    return parse_responses(replies).orderBy("batch", "line_no").limit(target)


def generate_grounded(chunks: DataFrame, generator: Generator, target: int, domain: str, abstain: float = 0.15, per_prompt: int = 2, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """(batch, abstain, line_no, instruction, input, output): records grounded in chunks(text, source, section).

    The first batches, a share `abstain` of them, ask for records that the reference does not answer. The reference and
    the query stand between markers in the input. Records whose output names an identifier that their input lacks go.
    """
    plan = plan_batches(chunks.sparkSession, target, BATCH, abstain)
    drawn = _drawn(plan, chunks.withColumn("key", F.sha2(F.concat_ws("\u0001", "source", "section", "text"), 256)), "key", per_prompt, seed)
    batches = plan.join(render_reference(drawn, ["batch"], "place"), "batch")
    text = lambda kind: filled(kind, n=F.col("n"), domain=F.lit(domain), reference=F.col("reference"))
    prompts = batches.withColumn("prompt", F.when(F.col("abstain"), text("abstain")).otherwise(text("grounded")))
    replies = map_backend(prompts, generator.generate, "prompt", "response", partitions).select("batch", "abstain", "reference", "response")
    found = parse_responses(replies).orderBy("batch", "line_no").limit(target)
    given = F.concat(F.lit(REFERENCE[0]), F.col("reference"), F.lit(REFERENCE[1] + "\n" + QUERY[0]), F.col("input"), F.lit(QUERY[1]))
    return validate_grounded(found.withColumn("input", given)).drop("reference")


def validate_grounded(df: DataFrame, allow: tuple[str, ...] = KNOWN_IDENTIFIERS) -> DataFrame:
    """The rows with an output that names no identifier (IDENTIFIER) but those of their input and the allowed ones."""
    rows = ungrounded(df.where(F.length(py_strip(F.col("output"))) > 0), list(allow))
    return rows.where(F.size("ungrounded") == 0).drop("ungrounded")


def generate_pairs(chunks: DataFrame, generator: Generator, target: int, domain: str, per_chunk: int = QUERIES_A_CHUNK, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """(query, positive, source): queries that sampled chunks(text, source) answer, per_chunk of each; the first `target`.

    As many chunks are sampled as the target needs, ceil(target / per_chunk), and no more are sent to the backend.
    """
    needed = -(-target // per_chunk)
    picked = sample_n(chunks.withColumn("key", F.sha2(F.concat_ws("\u0001", "source", "text"), 256)), "key", needed, seed)
    prompts = picked.withColumn("prompt", filled("queries", n=F.lit(per_chunk), domain=F.lit(domain), reference=F.substring("text", 1, CHUNK_CHARS)))
    replies = map_backend(prompts, generator.generate, "prompt", "response", partitions)
    queries = parse_queries(replies, "response")
    return queries.orderBy("key", "line_no").limit(target).select("query", F.col("text").alias("positive"), "source")


def parse_queries(df: DataFrame, text: str = "response") -> DataFrame:
    """df with line_no and query for each line of the text that is a JSON object with a query that is not blank."""
    lines = df.select("*", F.posexplode(F.split(py_strip(F.col(text)), r"\r\n|\r|\n")).alias("line_no", "line")).where(py_strip(F.col("line")).startswith("{"))
    query = py_strip(F.from_json("line", "query string")["query"])
    return lines.withColumn("query", query).where(F.length("query") > 0).drop(text, "line")


def encode_texts(df: DataFrame, encoder: Encoder, text: str = "text", out: str = "vector", most_chars: int = 8_000) -> DataFrame:
    """df with each text's vector, in Arrow batches; the vector goes with its row, so nothing is matched by position."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.float32())
        for batch in batches:
            given = (batch.slice(lo, hi - lo).to_pylist() for lo, hi in pieces(batch))
            vectors = [pa.array(list(encoder.encode([(t or "")[:most_chars] for t in texts])), kind) for texts in given]
            yield pa.concat_arrays(vectors) if vectors else pa.array([], kind)

    return df.withColumn(out, run(F.col(text)))


def infer(samples: DataFrame, generator: Generator, order: list[str], cap: int | None = None, partitions: int | None = None) -> DataFrame:
    """samples(instruction, input, output) with predicted (without thoughts) for the rows whose call succeeded.

    cap takes the first rows in this order, as for a baseline that is asked only a few.
    """
    rows = samples.orderBy(*order).limit(cap) if cap else samples
    blank = F.length(F.coalesce("instruction", F.lit(""))) == 0
    prompt = F.when(blank, F.col("input")).otherwise(F.concat("instruction", F.lit("\n\n"), "input"))
    replies = map_backend(rows.withColumn("prompt", prompt), generator.generate, "prompt", "reply", partitions)
    return replies.where("reply is not null").withColumn("predicted", strip_think(F.col("reply"))).drop("prompt", "reply")


def judge_predictions(predictions: DataFrame, judge: Judge, domain: str, partitions: int | None = 10) -> DataFrame:
    """predictions(input, output, predicted) with correct and reasoning; a judge that fails makes the row incorrect."""
    text = filled("judge", domain=F.lit(domain), input=F.substring("input", 1, 500), expected=F.col("output"), predicted=F.substring("predicted", 1, 200))
    rows = map_backend(predictions.withColumn("prompt", text), judge.judge, "prompt", "reply", partitions)
    said = judge_line(F.coalesce("reply", F.lit("INCORRECT: judge error")))
    return rows.withColumn("said", said).select(*predictions.columns, "said.correct", "said.reasoning")


def gate_answers(answers: DataFrame, judge: Judge, partitions: int | None = None) -> DataFrame:
    """answers(query, draft, context) with escalate and reason: a draft passes only where the gate says so."""
    cut = lambda c, n: F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), 1, n)
    context = F.when(F.length("context") > 0, F.col("context")).otherwise("(none)")
    text = filled("gate", query=cut(F.col("query"), 2_000), draft=cut(F.col("draft"), 4_000), context=cut(context, 12_000))
    rows = map_backend(answers.withColumn("prompt", text), judge.judge, "prompt", "reply", partitions)
    return rows.withColumn("said", gate_verdict(F.col("draft"), F.col("reply"))).select(*answers.columns, "said.escalate", "said.reason")


