"""A distributed positional index of words, searched for phrases and for words near each other; benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import cut

#: Words of a text before A-Z are lowered, and the letters that are.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows up to which terms, phrases or documents are broadcast (some 100 bytes each); more meet the postings in a join.
BROADCAST_ROWS = 200_000
DOC = ("doc_id", "same")


def words_of(text: str = "text") -> Column:
    """Words of a text in order, letters as they stand."""
    return F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))


def lowered(word: str) -> Column:
    """The word with A-Z lowered and nothing else."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _small(df: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _of_doc() -> Column:
    """Whether (doc_id, same) is (d, s)."""
    return (F.col("same") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d"))


def index_words(docs: DataFrame, terms: DataFrame | None = None, limit: int = BROADCAST_ROWS, ends: bool = False) -> DataFrame:
    """The index: postings (term, doc_id, same, pos) of docs(doc_id, text), written with each term's rows together.

    `same` is a hash of the text, so that unlike texts under one doc_id, or under none, are told apart; equal rows give
    equal postings. With `terms` (term), only their postings are stored. pos counts a text's words from 0; null and empty
    texts have none. With `ends`, each row, those too, has one more posting of the empty term, at its number of words.
    """
    words = words_of() if not ends else F.array_append(F.coalesce(words_of(), F.array().cast("array<string>")), F.lit(""))
    each = docs.select("doc_id", F.xxhash64("text").alias("same"), F.posexplode(words).alias("pos", "word"))
    postings = each.select(lowered("word").alias("term"), "doc_id", "same", "pos")
    if terms is not None:
        wanted = terms.select(F.col("term").alias("wanted"))
        wanted = wanted.union(wanted.sparkSession.createDataFrame([("",)], "wanted string")) if ends else wanted
        postings = postings.join(_small(wanted.distinct(), limit), F.col("term") == F.col("wanted")).drop("wanted")
    return cut(postings.sortWithinPartitions("term"))


def phrases_of(items: DataFrame, size: int = 10) -> DataFrame:
    """(item_id, phrase, terms): each run of `size` words of items(item_id, text); fewer words are one run, none give none."""
    each = items.select("item_id", F.transform(words_of(), lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))).alias("w")).where("size(w) > 0")
    runs = each.select("item_id", F.expr(f"explode(transform(sequence(1, greatest(size(w) - {size - 1}, 1)), i -> slice(w, i, {size})))").alias("terms"))
    return runs.select("item_id", F.md5(F.array_join("terms", " ").cast("binary")).alias("phrase"), "terms").distinct()


def _rarest_first(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, n, first, second, rest): each phrase's terms with their offsets, the rarest of the index first.

    Phrases with a term that the index does not hold occur nowhere and go.
    """
    each = phrases.select("phrase", "terms").distinct().select("phrase", F.size("terms").alias("n"), F.posexplode("terms").alias("off", "term"))
    numbers = index.groupBy("term").agg(F.count("*").alias("number"))
    sorted_terms = each.join(numbers, "term").groupBy("phrase", "n").agg(F.array_sort(F.collect_list(F.struct("number", "off", "term"))).alias("t")).where("size(t) = n")
    return cut(sorted_terms.select("phrase", "n", F.expr("t[0]").alias("first"), F.expr("get(t, 1)").alias("second"), F.expr("slice(t, 3, greatest(n - 2, 0))").alias("rest")))


def phrase_matches(index: DataFrame, phrases: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, same, phrase, start, n): every place where all terms of phrases(phrase, terms) stand one after another.

    Postings of a phrase's rarest term, moved back by its offset, give the places to look at; those that the second
    rarest term's postings confirm meet the postings of the other terms, all of which must confirm them.
    """
    ranked = _rarest_first(index, phrases)
    place = [*DOC, "phrase", "start"]
    first = ranked.select("phrase", "n", "second", "rest", F.col("first.term").alias("term"), F.col("first.off").alias("off"))
    found = index.join(_small(first, limit), "term").select(*DOC, "phrase", (F.col("pos") - F.col("off")).alias("start"), "n", "second", "rest").where("start >= 0")
    single = found.where("n = 1").select(*place, "n").distinct()
    wanted = ranked.where("n > 1").select(F.col("second.term").alias("term")).distinct()
    lists = index.join(_small(wanted, limit), "term", "left_semi")
    more = found.where("n > 1").select(*place, "n", "rest", F.col("second.term").alias("term"), (F.col("start") + F.col("second.off")).alias("at"))
    more = more.join(lists.toDF("t", "d", "s", "p"), (F.col("term") == F.col("t")) & (F.col("at") == F.col("p")) & _of_doc())
    more = cut(more.select(*place, "n", "rest").dropDuplicates(place))
    left = more.where("n > 2").select(*place, "n", F.explode("rest").alias("r")).select(*place, "n", F.col("r.term").alias("term"), (F.col("start") + F.col("r.off")).alias("at"))
    held = more.select(*DOC).distinct()
    lists = index.join(_small(held, limit).toDF("d", "s"), _of_doc(), "left_semi").distinct()
    left = left.join(lists.toDF("t", "d", "s", "p"), (F.col("term") == F.col("t")) & (F.col("at") == F.col("p")) & _of_doc())
    whole = left.groupBy(*place, "n").agg(F.count("*").alias("confirmed")).where("confirmed = n - 2")
    return single.union(more.where("n = 2").select(*place, "n")).union(whole.select(*place, "n"))


def proximity_matches(index: DataFrame, phrases: DataFrame, within: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, same, phrase, start): places of a term from which `within` words hold all terms of phrases(phrase, terms).

    The terms may stand in any order, among other words; a term that a phrase repeats counts once. Places are looked for
    around the postings of a phrase's rarest term, in blocks of `within` positions.
    """
    terms = phrases.select("phrase", F.array_distinct("terms").alias("terms"))
    ranked = _rarest_first(index, terms).select("phrase", "n", "first", F.expr("transform(array_compact(array_append(array_append(rest, second), first)), x -> x.term)").alias("terms"))
    rarest = _small(ranked.select("phrase", "n", "terms", F.col("first.term").alias("term")), limit)
    anchors = index.join(rarest, "term").select(*DOC, "phrase", "n", F.col("pos").alias("anchor"), "terms").distinct()
    around = anchors.select("*", F.explode("terms").alias("near")).select("*", F.expr(f"explode(array(anchor div {within} - 1, anchor div {within}, anchor div {within} + 1))").alias("block")).drop("terms")
    lists = index.distinct().select(F.col("term").alias("t"), F.col("doc_id").alias("d"), F.col("same").alias("s"), "pos", F.expr(f"pos div {within}").alias("b"))
    near = around.join(lists, (F.col("near") == F.col("t")) & (F.col("block") == F.col("b")) & _of_doc()).where(f"abs(pos - anchor) < {within}")
    held = near.groupBy(*DOC, "phrase", "n", "anchor").agg(F.collect_list(F.struct("pos", "near")).alias("hits"))
    whole = f"h -> h.pos >= lo and h.pos < lo + {within}"
    starts = f"filter(array_distinct(transform(hits, h -> h.pos)), lo -> lo <= anchor and anchor < lo + {within} and size(array_distinct(transform(filter(hits, {whole}), h -> h.near))) = n)"
    return held.select(*DOC, "phrase", F.explode(F.expr(starts)).alias("start")).distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, limit: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of docs(doc_id, text).

    A word is hit inside any occurrence of a run of `size` words of items(item_id, text); an item of fewer words is one
    run. Null and empty texts have no words. Rows that repeat an item_id are one item with all their runs; an item without
    an id hits words but is not listed or counted. Rows that repeat a document give one row each with the same figures;
    unlike texts under one doc_id, or under none, are judged on their own. Other columns are ignored.
    """
    runs = cut(phrases_of(items.select("item_id", "text"), size))
    docs = docs.select("doc_id", "text")
    index = index_words(docs, runs.select(F.explode("terms").alias("term")), limit, ends=True)
    found = cut(phrase_matches(index, runs.select("phrase", "terms"), limit))
    before = Window.partitionBy(*DOC).orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    ends = found.select(*DOC, "start", F.col("n").cast("long").alias("n")).distinct()
    fresh = ends.withColumn("from", F.greatest("start", F.max(F.col("start") + F.col("n")).over(before)))
    hits = fresh.groupBy(*DOC).agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("n") - F.col("from"))).alias("n_hit"))
    names = found.select(*DOC, "phrase").distinct().join(_small(runs.where("item_id is not null").select("phrase", F.col("item_id").cast("string").alias("item")), limit), "phrase")
    listed = names.groupBy(*DOC).agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = hits.join(listed.toDF("d", "s", "items"), _of_doc(), "left").select(F.col("doc_id").alias("d"), F.col("same").alias("s"), "n_hit", "items")
    every = index.where("term = ''").select(*DOC, F.col("pos").cast("long").alias("n_words"))
    out = every.join(both, _of_doc(), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
