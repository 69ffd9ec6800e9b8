"""Extraction end to end: fitting a token tagger, extracting entities with it, and the baseline that only remembers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import py_strip
from tesserae.operators.automaton import AUTOMATON_BYTES, contained, small_enough
from tesserae.operators.logistic import lbfgs, mean_loss
from tesserae.operators.profile import class_weights
from tesserae.operators.records import keep_first, numbered
from tesserae.operators.tagger import decode_bio, feature_rows, features, score_tags, tag_own, tokens
from tesserae.operators.written import written


def tagged(df: DataFrame, key: str, text: str = "text", entities: str = "entities") -> DataFrame:
    """(key, pos, tok, s, e, tag) of texts with their gold entities, each found wherever its surface stands in the text."""
    return tag_own(df, key, text, entities)


#: Most features that have a weight of their own (for each class); of more, each has one of so many by a hash.
FEATURES = 500_000


def fit_tagger(df: DataFrame, key: str, text: str = "text", entities: str = "entities", c: float = 4.0, most: int = FEATURES) -> tuple[DataFrame, DataFrame]:
    """(weights(feature, class, weight), intercepts(class, intercept)) of a balanced logistic tagger on one-hot features.

    Features are numbered in order (see numbered), or hashed where there are more than `most`, which bounds what goes to
    the tasks and back. A token's features are lists of numbers and values; loss and gradient are summed over partitions.
    """
    spark = df.sparkSession
    rows = written(tagged(df, key, text, entities))
    facts = feature_rows(features(rows.select(key, "pos", "tok"), key), key)
    vocabulary = written(numbered(facts.select("feature").distinct(), ["feature"], "at").select("feature", (F.col("at") - 1).cast("int").alias("at")))
    n = vocabulary.count()
    if n > most:
        vocabulary, n = vocabulary.select("feature", F.pmod(F.xxhash64("feature"), F.lit(most)).cast("int").alias("at")), most
    classes = [r[0] for r in rows.select("tag").distinct().orderBy("tag").collect()]  # two a type and O
    if not classes:
        return spark.createDataFrame([], "feature string, class string, weight double"), spark.createDataFrame([], "class string, intercept double")
    held = facts.join(vocabulary, "feature").groupBy(key, "pos").agg(F.collect_list(F.struct("at", "value")).alias("x"))
    code = F.array_position(F.array(*map(F.lit, classes)), F.col("tag")).cast("int") - 1
    weighted = rows.join(class_weights(rows, "tag").withColumnRenamed("label", "tag"), "tag").join(held, [key, "pos"])
    train = written(weighted.select(F.expr("transform(x, f -> f.at)").alias("at"), F.expr("transform(x, f -> f.value)").alias("value"), code.alias("label"), F.col("weight").cast("double").alias("weight")))
    penalty = 1 / (c * max(1, train.count()))
    w = lbfgs(lambda w: mean_loss(train, w, penalty), np.zeros((n + 1, len(classes))))
    bias = w[-1] - w[-1].mean()
    table = ((at, k, float(w[at, j])) for at in range(n) for j, k in enumerate(classes))
    own = spark.createDataFrame(table, "at int, class string, weight double")
    return vocabulary.join(own, "at").select("feature", "class", "weight"), spark.createDataFrame([(k, float(b)) for k, b in zip(classes, bias, strict=True)], "class string, intercept double")


def extract(df: DataFrame, weights: DataFrame, intercepts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, type, surface, s, e): entities that the tagger finds; of equal ones (whatever their case) the first."""
    toks = tokens(df, key, text)
    best = score_tags(feature_rows(features(toks, key), key), weights, intercepts, key)
    spans = decode_bio(toks.join(best.withColumnRenamed("class", "tag"), [key, "pos"]), key)
    return surfaces(df, spans, key, text)


def surfaces(df: DataFrame, spans: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, type, surface, s, e) of spans(key, type, s, e) in the texts, blank and repeated ones left out."""
    found = spans.join(df.select(key, text), key).withColumn("surface", F.substring(F.col(text), F.col("s") + 1, F.col("e") - F.col("s")))
    found = found.withColumn("folded", F.lower(py_strip(F.col("surface")))).where(F.length("folded") > 0)
    return keep_first(found, [key, "type", "folded"], ["s"]).select(key, "type", "surface", "s", "e")


def memorized(train: DataFrame, order: str, entities: str = "entities") -> DataFrame:
    """(surface, type): each surface of the training rows, folded, with the type that it was first seen with."""
    rows = train.select(order, F.posexplode(entities).alias("ord", "e"))
    by = rows.groupBy(F.lower(py_strip(F.col("e.text"))).alias("surface"))
    return by.agg(F.min_by("e.type", F.struct(order, "ord")).alias("type")).where("surface <> ''")


#: First characters by which surfaces too many for one automaton meet the texts that hold them.
HEAD = 3


def recall_memorized(df: DataFrame, known: DataFrame, key: str, text: str = "text", most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(key, type, surface): the known surfaces that each text contains, whatever its case.

    Surfaces of up to `most_bytes` in all are looked for in one scan of the texts by an automaton. More are joined by
    their first HEAD characters with the texts that hold these, and what is found is checked; of those only the ones that
    are shorter, bounded by the pairs of characters there are, go to every text.
    """
    low = df.select(key, F.lower(F.col(text)).alias("low"))
    if small_enough(known, most_bytes=most_bytes):
        return contained(low, known, key, "low")
    chars = low.select(key, "low", F.split("low", "").alias("chars")).where(F.length("low") >= HEAD)
    head = lambda i: F.concat(*(F.get("chars", i + k) for k in range(HEAD)))
    heads = chars.select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("chars") - HEAD), head))).alias("head"))
    long = known.where(F.length("surface") >= HEAD).withColumn("head", F.substring("surface", 1, HEAD))
    found = heads.join(long, "head").join(low, key).where(F.contains("low", "surface"))
    return found.select(key, "type", "surface").unionByName(contained(low, known.where(F.length("surface") < HEAD), key, "low"))
