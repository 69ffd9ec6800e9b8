"""Operators without SQL: chunk rules, fits against closed forms, backends, artifacts, configurations, sources."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import manifests, replies, text
from tesserae.operators import cases, chunk, extract, generate, heads, patches, records, retrieve, sizing, tagger
from tesserae.plans.stages import Pipeline
from tesserae.sources import artifacts, files


def test_paragraph_chunks_by_hand():
    a, b, c = "a" * 150, "b" * 100, "c" * 90
    assert list(chunk.paragraph_chunks("  short  ")) == ["short"] and list(chunk.paragraph_chunks("   ")) == []
    text_ = f"{a}\n\n \n\n{b}\n\n{c}"
    assert list(chunk.paragraph_chunks(text_, limit=1200)) == [f"{a}\n\n{b}\n\n{c}"]
    # a and b have 252 characters together: c would make 344, above 300, and the next chunk begins 20 before its end
    assert list(chunk.paragraph_chunks(text_, limit=300, overlap=20, least=100)) == [f"{a}\n\n{b}", f"{b[-20:]}\n\n{c}"]
    # a alone is below the least length, so b joins it although that is above the limit; the rest is too short
    assert list(chunk.paragraph_chunks(text_, limit=160, overlap=0, least=200)) == [f"{a}\n\n{b}"]


def test_section_chunks_by_hand():
    body = "x" * 60
    text_ = f"---\ntitle: t\n---\nintro {body}\n{body}\n# One #\n{body}\n## Two\n{body}\n{body}\n#no heading\n{body}"
    got = list(chunk.section_chunks(text_, "file"))
    # One keeps 8 + 61 characters, no more than 100, and goes
    assert got == [("file", f"intro {body}\n{body}"), ("Two", f"## Two\n{body}\n{body}\n#no heading\n{body}")]
    assert list(chunk.section_chunks("# A\n" + "y" * 40)) == [] and list(chunk.section_chunks("# A\n" + "y" * 60)) == [("A", "# A\n" + "y" * 60)]
    long = "\n".join(f"line {i:04d}" for i in range(100))
    parts = [c for _, c in chunk.section_chunks(long, "s", limit=300, overlap=50)]
    assert all(len(p) <= 311 for p in parts) and all(p.split("\n")[-1] in q for p, q in zip(parts, parts[1:], strict=False))
    assert set(" ".join(parts).split()) >= {f"{i:04d}" for i in range(100)}


def test_chunks_cover_texts():
    """Chunks are slices in order; whatever the limits, all paragraphs up to the last chunk's end are in some chunk."""
    rng = random.Random(4)
    for _ in range(300):
        paragraphs = ["".join(rng.choice("ab c") for _ in range(rng.choice([1, 20, 400]))).strip() or "x" for _ in range(rng.randint(1, 30))]
        limit, overlap, least = rng.choice([(1200, 150, 200), (100, 10, 30), (50, 40, 45)])
        got = list(chunk.paragraph_chunks("\n\n".join(paragraphs), limit=limit, overlap=overlap, least=least))
        whole, at = "\n\n".join(paragraphs), 0
        for c in got:
            found = whole.find(c, max(0, at - overlap - 2))
            assert found >= 0 and found <= at + 2
            at = found + len(c)
        assert len(whole) - at < least + 2 or not got


def test_heads_against_closed_forms(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + 3 + rng.normal(size=300) * 0.1
    k = (x[:, 0] + rng.normal(size=300) * 0.3 > 0).astype(int) + (x[:, 1] > 1)
    df = spark.createDataFrame([([float(a) for a in r], float(t), f"c{c}") for r, t, c in zip(x, y, k, strict=True)], "v array<double>, y double, k string")
    ridge = heads.fit_regressor(df, "v", "y", 1.0)
    centred = x - x.mean(0)
    want = np.linalg.solve(centred.T @ centred + np.eye(4), centred.T @ (y - y.mean()))
    assert np.allclose(ridge["coef"], want, atol=1e-6) and ridge["intercept"] == pytest.approx(y.mean() - x.mean(0) @ want, abs=1e-6)
    head = heads.fit_classifier(df, "v", "k", 10.0)
    z = x @ np.array(head["coef"]).T + head["intercept"]
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    one = (k[:, None] == np.arange(3)).astype(float)
    weight = 300 / (3 * one.sum(0))[k]
    gradient = ((p - one) * weight[:, None]).T @ x + np.array(head["coef"]) / 10
    assert np.abs(gradient).max() < 0.05  # the penalised balanced loss is at its least
    found = heads.predict_class(df, head, "v").select("predicted").collect()
    assert [r["predicted"] for r in found] == [f"c{i}" for i in z.argmax(1)]


def test_tagger_learns_and_extracts(spark):
    rows = [(i, f"please check svc-{i} in Berlin now", [("S", f"svc-{i}"), ("C", "Berlin")]) for i in range(12)] + [(50, "nothing here", [])]
    df = spark.createDataFrame(rows, "id long, text string, entities array<struct<type:string,text:string>>")
    weights, intercepts = extract.fit_tagger(df, "id")
    new = spark.createDataFrame([(1, "now svc-99 in Berlin and berlin"), (2, ""), (3, None)], "id long, text string")
    got = {(r["type"], r["surface"]) for r in extract.extract(new, weights, intercepts, "id").collect()}
    assert got == {("S", "svc-99"), ("C", "Berlin")}
    spans = tagger.find_spans(new, spark.createDataFrame([("C", "in", 0), ("D", "Berlin", 1)], "type string, surface string, ord int"), "id")
    assert {(r["surface"], r["gs"]) for r in spans.collect()} == {("in", 11), ("in", 18), ("in", 29), ("Berlin", 14)}
    known = extract.memorized(df, "id")
    short = known.union(spark.createDataFrame([("in", "D"), ("é", "D")], known.schema))
    for most in (100, 0):
        found = extract.recall_memorized(new, short, "id", most_bytes=most).collect()
        assert sorted(map(tuple, found)) == [(1, "C", "berlin"), (1, "D", "in"), (1, "S", "svc-9")]


def test_vectors_may_be_odd(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.5]), (4, [0.0, 2.0]), (5, [None, 1.0]), (6, [3.0, 0.0])], "doc_id long, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "query_id long, vector array<double>")
    assert [(r["doc_id"], r["rank"]) for r in retrieve.knn(queries, index, 2).orderBy("rank").collect()] == [(6, 1), (1, 2)]
    assert retrieve.knn(queries.limit(0), index, 2).count() == 0


def test_bm25_by_set_and_by_join(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    plans = [sorted((r["query_id"], r["doc_id"], round(r["score"], 6), r["rank"]) for r in retrieve.bm25(q, docs, 3, wanted_terms=n).collect()) for n in (10_000, 0)]
    assert plans[0] == plans[1] and plans[0]
    assert retrieve.bm25(q.withColumn("text", F.lit("  ")), docs, 3).count() == 0


def test_backends(spark):
    class Failing:
        """A backend that fails for whole batches and for some rows."""

        def generate(self, prompts):
            if len(prompts) > 1 or "bad" in prompts[0]:
                raise RuntimeError("no")
            return [f"ok {prompts[0]}"]

        def score(self, queries, texts):
            raise RuntimeError("no")

    waits, calls = [], []

    def throttled(x):
        calls.append(x)
        raise generate.Throttled if len(calls) < 3 else RuntimeError

    assert generate.retrying(throttled, sleep=waits.append)(1) is None and waits == [2, 4] and len(calls) == 3
    assert generate.retrying(lambda x: x + 1, sleep=waits.append)(1) == 2
    df = spark.createDataFrame([(i, "bad" if i == 2 else f"p{i}") for i in range(5)], "id long, prompt string").coalesce(1)
    got = {r["id"]: r["out"] for r in generate.map_backend(df, Failing().generate, "prompt", "out", sleep=lambda s: None).collect()}
    assert got == {0: "ok p0", 1: "ok p1", 2: None, 3: "ok p3", 4: "ok p4"}
    pairs = spark.createDataFrame([(1, "q", i, f"t{i}", 4 - i) for i in range(4)], "query_id long, query string, doc_id long, text string, place int")
    assert [r["doc_id"] for r in retrieve.rerank(pairs, Failing(), 2).orderBy("rank").collect()] == [3, 2]


def test_generation_flow(spark):
    sources = spark.createDataFrame([(f"s{i}", "x" * 900) for i in range(30)], "source string, content string")
    found = generate.generate_records(sources, generate.StubGenerator(), 12, "d").collect()
    again = generate.generate_records(sources, generate.StubGenerator(), 12, "d").collect()
    assert len(found) == 12 and found == again and {r["batch"] for r in found} == {0, 1, 2}
    fewer = generate.map_backend(sources.select(F.concat(F.lit("Write 2 records as x"), "source").alias("p")), generate.StubGenerator(3).generate, "p", "r", sleep=lambda s: None)
    assert 0 < fewer.where("r is null").count() < 30
    chunks = spark.createDataFrame([(f"text {i} a.bc/d{i}", f"s{i}", "sec" if i % 2 else None) for i in range(9)], "text string, source string, section string")
    grounded = generate.generate_grounded(chunks, generate.StubGenerator(), 20, "d", abstain=0.5).collect()
    assert len(grounded) == 20 and sum(r["abstain"] for r in grounded) == 10
    assert all(generate.REFERENCE[0] in r["input"] and generate.QUERY[1] in r["input"] for r in grounded)
    pairs = generate.generate_pairs(chunks, generate.StubGenerator(), 7, "d").collect()
    assert len(pairs) == 7 and len({r["positive"] for r in pairs}) == 3
    encoder = generate.HashingEncoder(8)
    x = encoder.encode(["a b", "a b", ""])
    assert np.allclose(x[0], x[1]) and np.linalg.norm(x[0]) == pytest.approx(1) and not x[2].any()


def test_artifacts(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("i", "q", "é" * 40), ("i", "q", ""), ("i", "q", "b" * 9)], "instruction string, input string, output string")
    assert artifacts.write_output_stats(df, f"{root}/stats.json") == {"max_output_tokens": 10, "avg_output_tokens": 6, "p95_output_tokens": 10, "sample_count": 2}
    assert artifacts.read_json(spark, f"{root}/stats.json")["sample_count"] == 2
    assert artifacts.write_output_stats(df.where("output = ''"), f"{root}/none.json") is None and artifacts.read_json(spark, f"{root}/none.json") is None
    artifacts.write_head(spark, f"{root}/m", {"classes": ["a", "b"]}, {"accuracy": 1.0})
    assert artifacts.read_json(spark, f"{root}/m/labels.json") == {"labels": ["a", "b"]}
    artifacts.write_sets(f"{root}/out", train=df.limit(2), eval=df.limit(1), corpus=df)
    assert files.read_jsonl(spark, f"{root}/out/corpus.jsonl", "output string").count() == 3
    card = spark.createDataFrame([("c1", "pass"), ("c2", "fail")], "id string, status string")
    assert artifacts.load_baseline(spark, f"{root}/cards") is None
    artifacts.save_scorecard(card, f"{root}/cards", "t1", baseline=True)
    assert artifacts.load_baseline(spark, f"{root}/cards").count() == 2
    for n in (5, 40, 7):
        (tmp_path / f"run/checkpoint-{n}").mkdir(parents=True)
    assert artifacts.checkpoints(spark, f"{root}/run").first()["step"] == 40
    (tmp_path / "state.json").write_text(json.dumps({"global_step": 3, "log_history": [{"step": 1, "loss": 2.0}, {"step": 2, "eval_loss": 1.5}, {"step": 3, "loss": 1.0}]}))
    assert [tuple(r) for r in artifacts.training_log(spark, f"{root}/state.json").collect()] == [(1, 2.0, None), (2, None, 1.5), (3, 1.0, None)]
    chunks = spark.createDataFrame([("a b", "s", "x"), ("c", "t", "y")], "text string, source string, section string")
    artifacts.index_chunks(chunks, generate.HashingEncoder(4), f"{root}/index")
    artifacts.index_chunks(chunks, generate.HashingEncoder(4), f"{root}/index", append=True)
    assert spark.read.parquet(f"{root}/index").where("size(vector) = 4").count() == 4
    assert artifacts.of_source(chunks, "t").count() == 1 and artifacts.of_source(chunks, None).count() == 2
    page = artifacts.render_report("a<b", {"t": spark.createDataFrame([("<x>", None)], "c string, d string")})
    assert "a&lt;b" in page and "&lt;x&gt;" in page


def test_sources(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/guide.md").write_text("intro " + "x" * 120 + "\n# Part\n" + "y" * 120)
    (tmp_path / "docs/_index.md").write_text("z" * 300)
    (tmp_path / "docs/note.txt").write_text("z" * 300)
    (tmp_path / "docs/bad.adoc").write_bytes(b"a" * 150)
    got = {(r["section"], r["chunk_no"]) for r in artifacts.section_chunks_of(spark, str(tmp_path / "docs"), "kb").collect()}
    assert got == {("guide", 0), ("Part", 1), ("bad.adoc", 0)}
    (tmp_path / "review.jsonl").write_text('{"instruction":"i","input":"a","output":"b"}\n\n{"input":"a","output":1}\n{"input":"a","output":["x"]}\nnot json\n{"output":"only"}\n')
    assert [tuple(r) for r in artifacts.read_review(spark, str(tmp_path / "review.jsonl")).collect()] == [("i", "a", "b"), (None, None, "only")]
    (tmp_path / "raw/a").mkdir(parents=True)
    (tmp_path / "raw/a/one.txt").write_bytes(b" caf\xc3\xa9 \xff ")
    (tmp_path / "raw/a/blank.txt").write_text("  ")
    assert [r["content"] for r in files.read_raw(spark, str(tmp_path / "raw"), ["a"]).collect()] == ["café �"]
    (tmp_path / "k.jsonl").write_text(json.dumps({"text": "t" * 80, "source": "s"}) + "\n" + json.dumps({"text": "short"}) + "\n{oops\n")
    assert files.read_grounding_corpus(spark, str(tmp_path)).count() == 1
    (tmp_path / "cases.yaml").write_text("- id: a\n  query: q\n  must_not_say: [x, y]\n- id: b\n  should_reject: true\n")
    found = {r["id"]: r for r in artifacts.read_cases(spark, str(tmp_path / "cases.yaml")).collect()}
    assert found["a"]["must_not_say"] == ["x", "y"] and found["b"]["should_reject"] is True


GOOD = {"project": {"name": "a-b", "domain": "d", "task": "classification", "labels": {"k": ["x"]}}, "data": {"bucket": "bucket.one", "path": "p/", "synthetic": {"model": "m", "pairs": 10}}, "model": {"base": "e"}}


@pytest.mark.parametrize(
    ("path", "value", "field"),
    [
        ("project.name", "A_b", "project.name"), ("project.name", None, "project.name"), ("project.task", "reranking", "project.task"), ("project.task", "x", "project.task"), ("project.labels", None, "project.labels"),
        ("project.output_format", "free_form", "project.output_format"), ("model.base", "", "model.base"), ("model.quantize", "q9", "model.quantize"), ("model.head", "tree", "model.head"), ("data.bucket", "a", "data.bucket"),
        ("data.path", "a/../b", "data.path"), ("data.synthetic", None, "data.synthetic"), ("data.synthetic", {"model": "m", "pairs": 3}, "data.synthetic.pairs"), ("data.sources", [{}], "data.sources[0].path"), ("training.epochs", 21, "training.epochs"),
    ],
)
def test_config_rules(path, value, field):
    assert sizing.validate_config(GOOD) == []
    config = json.loads(json.dumps(GOOD))
    block = config
    *parts, last = path.split(".")
    for p in parts:
        block = block.setdefault(p, {})
    block[last] = value
    assert field in [f for f, _ in sizing.validate_config(config)]


def test_config_of_other_tasks():
    generation = {"project": {"name": "a", "domain": "d", "task": "generation"}, "data": {"bucket": "abc", "path": "p"}, "model": {"base": "m-7b", "head": "logistic"}}
    assert [f for f, _ in sizing.validate_config(generation)] == ["model.head"]
    embedding = GOOD | {"project": GOOD["project"] | {"task": "embedding"}}
    assert [f for f, _ in sizing.validate_config(embedding)] == ["project.labels", "data.sources"]


def test_patches_and_manifests(spark):
    tree = {"spec": {"template": {"spec": {"nodeSelector": {"a": "1", "b": "2"}}}}}
    patch = patches.plan(tree, "spec.template.spec.nodeSelector", "remove_unschedulable_nodeselector_keys", "", {"a"})
    assert patches.merged(tree, patch) == {"spec": {"template": {"spec": {"nodeSelector": {"a": "1"}}}}}
    assert patches.plan(tree, "capacity_type", "add_to_set", "spot") is None
    cpu = lambda shown: {"spec": {"limits": {"cpu": shown}}}
    same = [("1000m", "1"), ("1", "1000m"), (2, "2"), ("0.5", "500m"), ("1e3", "1k"), ("1Gi", "1024Mi"), ("1Gi", "1073741824")]
    unlike = [("1", "2"), ("1G", "1Gi"), (None, "1"), ("one", "one"), ("100m", "1"), (True, "1")]
    assert [patches.verified(cpu(a), "spec.limits.cpu", "set_quantity", b) for a, b in same + unlike] == [True] * 7 + [False] * 6
    assert patches.verified({"spec": {"replicas": 3}}, "spec.replicas", "set_int", "3") and not patches.verified({}, "spec.replicas", "set_int", "3")
    texts = ["hi\n```yaml\napiVersion: v1\nkind: Pod\n```\nbye", "see\napiVersion: v1\nkind: Pod\nmetadata:\n  name: x\nThat is all.", " none ", "a: [", "apiVersion: v1\nkind: Pod\nmetadata: {name: a}", None]
    c = F.col("t")
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(manifests.extract_manifest(c).alias("m"), manifests.lint_manifest(c).alias("l"), manifests.lint_draft(c).alias("d")).collect()
    assert [r["m"] for r in got[:3]] == ["apiVersion: v1\nkind: Pod", "apiVersion: v1\nkind: Pod\nmetadata:\n  name: x", "none"]
    assert got[3]["l"].startswith("Invalid YAML") and got[4]["l"] == manifests.SOUND and got[5]["l"] is None
    assert [len(r["d"]) for r in got] == [1, 0, 0, 0, 0, 0]
    assert manifests.pruned({"a": [None, "", {"b": {}}, 0, False], "c": ""}) == {"a": [0, False]}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    for raw, want in ((" 1_0 ", 10.0), ("1__0", None), (".5e1", 5.0), ("0.5d", None), ("-inf", float("-inf")), ("1.", 1.0), ("", None)):
        assert one(text.py_float(F.lit(raw))) == want
    assert np.isnan(one(text.py_float(F.lit("NaN"))))
    assert one(text.reference_text(F.lit("a]b[c"), "[", "]")) == "a]b[c" and one(text.reference_text(F.lit("a[b]c"), "[", "]")) == "b"
    assert one(replies.judge_line(F.lit("correct"))).asDict() == {"correct": True, "reasoning": ""}
    assert one(tagger.is_title(F.lit("Ab-Cd"))) and not one(tagger.is_title(F.lit("AbC"))) and not one(tagger.is_title(F.lit("12")))


def test_cases_with_nulls(spark):
    schema = "should_reject boolean, expected_category string, must_not_say array<string>, should_abstain boolean, config_is_valid boolean, leading_premise boolean, answer string, triage string, judge struct<verdict:string,abstained:boolean,invented_problem:boolean,followed_wrong_premise:boolean,hallucinated:boolean>"
    df = spark.createDataFrame([(None, None, None, None, None, None, "a", None, None), (True, None, ["A"], None, None, None, "aa", "reject", None)], schema)
    assert [r["status"] for r in cases.score_cases(df).collect()] == ["fail", "pass"]


def test_pipeline_resumes(spark, tmp_path):
    stages = [("one", lambda df: spark.range(3)), ("two", lambda df: df.where("id > 0"))]
    first = Pipeline(spark, str(tmp_path), stages)
    assert first.run().count() == 2 and first.ran == ["one", "two"]
    again = Pipeline(spark, str(tmp_path), stages)
    assert again.run().count() == 2 and again.ran == []
    forced = Pipeline(spark, str(tmp_path), stages)
    forced.run("two")
    assert forced.ran == ["two"] and records.nonempty(spark.createDataFrame([(" ",), ("a",)], "output string")).count() == 1


def test_corpus_export_and_index_stream(spark, tmp_path):
    from tesserae.streaming.index import append_index

    rows = [("a", "s", "x"), ("  ", "s", "x"), ("b", None, "y")]
    files.export_corpus(spark.createDataFrame(rows, "text string, source string, section string"), f"{tmp_path}/corpus")
    assert sorted(tuple(r) for r in files.read_jsonl(spark, f"{tmp_path}/corpus", "text string, source string, section string").collect()) == [("a", "s", "x"), ("b", None, "y")]
    schema = "doc_id long, text string"
    for part in range(2):
        spark.createDataFrame([(10 * part + i, f"t{i}") for i in range(3)], schema).write.mode("append").parquet(f"{tmp_path}/new")
        append_index(spark, f"{tmp_path}/new", schema, f"{tmp_path}/index", f"{tmp_path}/state").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/index").count() == 3 * (part + 1)  # each file once, whenever it came


def test_strict_and_lenient_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":"1"}\n{"a":\n{"a":"2"}\n')
    assert files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a string", strict=False).count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a string").collect()


def test_grounding_takes_lists_in_turn(spark):
    docs = spark.createDataFrame([(i, f"word{i} common", [1.0 if j == i else 0.0 for j in range(6)]) for i in range(6)], "doc_id long, text string, vector array<double>")
    q = spark.createDataFrame([(1, "word3", "word4", [0.9, 0.5, 0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.9, 0.0, 0.0, 0.1])], "query_id long, query string, answer string, query_vector array<double>, answer_vector array<double>")
    got = [r["doc_id"] for r in retrieve.grounding(q, docs, cap=5, dense_k=2, answer_k=2, query_k=2).orderBy("place").collect()]
    assert got == [0, 2, 4, 3, 1]  # first hits of the four lists in turn, then their second ones


def test_hybrid_caps(spark):
    hits = lambda ids: spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(ids)], "query_id long, doc_id long, rank int")
    found = retrieve.hybrid(hits(range(40)), hits(range(20, 60))).orderBy("place").collect()
    assert [r["doc_id"] for r in found] == [*range(30), *range(30, 35)]
    assert retrieve.hybrid(hits(range(40)), hits(range(50, 90)), broaden=4).count() == 34 + 19
