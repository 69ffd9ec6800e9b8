"""Small fixtures with rows worked out by hand."""

from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import chunk, records, tagger
from tesserae.plans.stages import Pipeline
from tesserae.sources.files import page_text


def test_scores(spark):
    cases = {"0.5": "0.5000", "85%": "0.8500", "0.5%": "0.5000", "85": None, '"0.7"': "0.7000", "0.7 because": "0.7000", "nan": None, "-0.1": None, "1": "1.0000", "1_0": None, "0.5d": None, "": None, "0.03125": "0.0312"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.parsed_score(F.col("t")).alias("s"))
    assert {r["t"]: r["s"] for r in df.collect()} == cases


def test_labels(spark):
    df = spark.createDataFrame([("a|b",), ("|a",), ("a|",), (" a | b ",), ("",)], "t string")
    got = df.select(*(T.primary_label(F.col("t"), m, ["b"] if m == "taxonomy" else None).alias(m) for m in ("first", "report", "taxonomy", "cli"))).collect()
    assert [tuple(r) for r in got] == [("a", "b", "b", "a"), ("", "a", None, "|a"), ("a", "a", None, "a"), ("a", "b", "b", "a"), ("", "", None, "")]


def test_paragraph_chunks():
    assert list(chunk.paragraph_chunks("x" * 199)) == ["x" * 199]
    assert list(chunk.paragraph_chunks("  ")) == []
    parts = list(chunk.paragraph_chunks("\n\n".join(c * 500 for c in "abcd")))
    assert [len(p) for p in parts] == [1002, 1154]
    assert parts[1].startswith("b" * 150 + "\n\n" + "c")


def test_section_chunks():
    text = "---\nx: 1\n---\n" + "short\n# One\n" + "a" * 120 + "\n## Two\n" + "b" * 60
    assert [s for s, _ in chunk.section_chunks(text)] == ["One", "Two"]


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Éçole v2.3.1, foo-bar/baz- 😀")], "k long, text string")
    got = tagger.tokens(df, "k").orderBy("pos").collect()
    assert [r["tok"] for r in got] == ["Éçole", "v2.3.1", ",", "foo-bar/baz", "-", "😀"]
    assert [(r["s"], r["e"]) for r in got][:3] == [(0, 5), (6, 12), (12, 13)]


def test_bio(spark):
    tags = ["I-X", "B-X", "I-X", "I-Y", "I-X", "B-Y", "B-Y", "I-Y"]
    df = spark.createDataFrame([(1, i, t, i, i + 1) for i, t in enumerate(tags)], "k long, pos long, tag string, s long, e long")
    assert sorted(tuple(r) for r in tagger.decode_bio(df, "k").collect()) == [(1, "X", 1, 3), (1, "Y", 5, 6), (1, "Y", 6, 8)]


def test_output_stats(spark):
    df = spark.createDataFrame([("x" * 4 * i,) for i in range(1, 21)] + [("  ",)], "output string")
    assert tuple(records.output_stats(df).first()) == (20, 10, 20, 20)


def test_split_falls_back_to_the_tail(spark):
    df = spark.range(20)
    assert records.split_positional(df, ["id"], 1.0).where("split = 'eval'").count() == 2
    assert records.split_positional(df, ["id"]).where("split = 'train'").count() == 18


def test_page_text():
    assert page_text("<body><nav>n</nav><article><p>a</p><footer>f</footer>b</article></body>") == "a\nb"
    assert page_text(None) == ""


def test_stages_skip_and_force(spark, tmp_path):
    stages = [("a", lambda _: spark.range(3)), ("b", lambda df: df.where("id > 0"))]
    run = Pipeline(spark, str(tmp_path), stages)
    assert run.run().count() == 2 and run.ran == ["a", "b"]
    run.ran.clear()
    assert run.run().count() == 2 and run.ran == []
    run.run(start="b")
    assert run.ran == ["b"]
