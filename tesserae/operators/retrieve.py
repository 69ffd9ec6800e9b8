"""Retrieval: exact vector search, BM25, hybrid candidates, interleaving, evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tesserae.operators.records import keep_first
from tesserae.operators.written import written

#: Vectors of one block of either side, most cells of an index, vectors that their pivots are chosen from.
BLOCK, CELLS, SAMPLE = 8192, 256, 4000
FOUND = "query_id long, doc_id long, score double"


def _usable(df: DataFrame, name: str, dim: int) -> DataFrame:
    """(name, vector) with vectors of this dimension as bytes of doubles; what holds a null or a NaN is left out."""
    whole = (F.size("vector") == dim) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")))
    rows = df.where(F.col(name).isNotNull() & F.col("vector").isNotNull()).where(whole)

    def packed(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in flat.reshape(batch.num_rows, dim)], pa.binary())], [name, "vector"])

    return rows.select(F.col(name).cast("long").alias(name), "vector").mapInArrow(packed, f"{name} long, vector binary")


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((x * x).sum(axis=1))
    return norm, x / np.where(norm > 0, norm, 1)[:, None]


def choose_pivots(x: np.ndarray, k: int) -> np.ndarray:
    """Directions of x, each as far as can be from those before it."""
    _, x = _directions(x)
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen]


def _best_in_block(k: int, dim: int):
    """For applyInArrow on one block of documents and one of queries: the k best of each query."""

    def run(rows: pa.Table) -> pa.Table:
        side, ids = rows.column("side").to_numpy(), rows.column("id").to_numpy()
        x = _matrix(rows.column("vector"), dim)
        docs = np.flatnonzero(side == 1)
        docs, queries = docs[np.argsort(ids[docs], kind="stable")], np.flatnonzero(side == 0)
        found = []
        step = max(1, (1 << 21) // max(1, len(docs)))
        for lo in range(0, len(queries) if len(docs) else 0, step):
            part = queries[lo : lo + step]
            score = x[part] @ x[docs].T
            there = docs
            if len(docs) > 4 * k:  # what is below every query's k-th best cannot be among the best
                keep = np.flatnonzero((score >= np.partition(score, -k, axis=1)[:, -k][:, None]).any(axis=0))
                score, there = score[:, keep], docs[keep]
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            found.append((np.repeat(ids[part], top.shape[1]), ids[there[top]].ravel(), np.take_along_axis(score, top, 1).ravel()))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table(dict(zip(("query_id", "doc_id", "score"), columns, strict=True)), schema=pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())]))

    return run


def knn(queries: DataFrame, index: DataFrame, k: int, cells: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best inner products; ties by doc_id.

    queries(query_id, vector), index(doc_id, vector). Vectors that are null, hold a null or a NaN, or have another
    dimension than the vector of the least query_id are left out; of rows that repeat an id each counts.

    An index of more than two blocks is dealt to cells by the nearest of some pivots, each with its least and largest
    norm and its largest angle from the pivot. A query meets the cell of its own nearest pivot first; the k-th best score
    there goes ahead, and only cells whose vectors can reach it (by the triangle inequality on angles) are met too. Both
    sides are met in blocks; nothing but pivots and the cells' figures passes the driver.
    """
    spark = queries.sparkSession
    dim = queries.where("vector is not null").agg(F.min_by(F.size("vector"), "query_id").alias("d")).first()["d"]
    if not dim:
        return spark.createDataFrame([], FOUND + ", rank int")
    asked, docs = _usable(queries, "query_id", dim), _usable(index, "doc_id", dim)
    n = index.count()
    cells = cells or (1 if n <= 2 * block else min(CELLS, int(n**0.5) // 8))
    pivots = np.zeros((1, dim))
    if cells > 1:
        place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
        rows = docs.where(place.cast("double") * n < float(2 * SAMPLE << 30)).orderBy(place, "doc_id").limit(SAMPLE).select("vector").collect()
        pivots = choose_pivots(np.frombuffer(b"".join(bytes(r["vector"]) for r in rows), "<f8").reshape(-1, dim), cells) if rows else pivots

    def near(batches):
        for batch in batches:
            norm, x = _directions(_matrix(batch.column(1), dim))
            dots = x @ pivots.T
            cell = dots.argmax(axis=1)
            angle = np.arccos(np.clip(dots[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(norm), pa.array(angle)], [*batch.schema.names, "cell", "norm", "angle"])

    placed = docs.mapInArrow(near, "doc_id long, vector binary, cell int, norm double, angle double")
    placed = written(placed) if cells > 1 else placed
    figures = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("norm").alias("least"), F.max("norm").alias("most"), F.max("angle").alias("wide")).collect()}  # a row a cell
    parts = {c: -(-r["n"] // block) for c, r in figures.items()}
    turns = -(-queries.count() // block)
    each = lambda at: F.sequence(F.lit(0), at - 1)
    blocks_of = F.create_map(*(F.lit(x) for c, p in parts.items() for x in (c, p))) if parts else F.create_map(F.lit(-1), F.lit(1))
    held = placed.select(F.lit(1).alias("side"), F.col("doc_id").alias("id"), "vector", "cell", F.pmod(F.xxhash64("doc_id"), F.element_at(blocks_of, F.col("cell"))).cast("int").alias("part"), F.explode(each(F.lit(max(1, turns)))).alias("turn"))

    def search(met: DataFrame) -> DataFrame:
        """FOUND of met(query_id, vector, cell): the k best of each query in each block of its cells."""
        mine = met.select(F.lit(0).alias("side"), F.col("query_id").alias("id"), "vector", "cell", F.explode(each(F.element_at(blocks_of, F.col("cell")))).alias("part"), F.pmod(F.xxhash64("query_id"), F.lit(max(1, turns))).cast("int").alias("turn"))
        return mine.union(held).groupBy("cell", "part", "turn").applyInArrow(_best_in_block(k, dim), FOUND)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    best = lambda df: df.withColumn("rank", rank).where(F.col("rank") <= k)
    if len(figures) < 2:
        only = next(iter(figures), -1)
        return best(search(asked.withColumn("cell", F.lit(only))) if figures else spark.createDataFrame([], FOUND))
    there = np.array(sorted(figures))
    least, most, wide = (np.array([figures[c][f] for c in there]) for f in ("least", "most", "wide"))

    def home(batches):
        for batch in batches:
            _, x = _directions(_matrix(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(there[(x @ pivots[there].T).argmax(axis=1)].astype(np.int32))], ["query_id", "vector", "cell"])

    homes = written(asked.mapInArrow(home, "query_id long, vector binary, cell int"))
    first = written(best(search(homes)).drop("rank"))
    ahead = first.withColumn("rank", rank).where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))

    def others(batches):
        for batch in batches:
            norm, x = _directions(_matrix(batch.column(1), dim))
            cosine = np.cos(np.maximum(0, np.arccos(np.clip(x @ pivots[there].T, -1, 1)) - wide - 1e-9))
            bound = norm[:, None] * np.where(cosine >= 0, most, least) * cosine
            reached = batch.column("reached").fill_null(-np.inf).to_numpy(zero_copy_only=False)
            wanted = (bound + 1e-9 * (1 + np.abs(bound)) >= reached[:, None]) & (there != batch.column("cell").to_numpy()[:, None])
            row, cell = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(there[cell].astype(np.int32))], ["query_id", "vector", "cell"])

    rest = homes.join(ahead, "query_id", "left").mapInArrow(others, "query_id long, vector binary, cell int")
    return best(first.union(search(rest)))


#: Documents and queries of one block where places are counted, documents met at once, scores that count as alike.
OWN_DOCS, OWN_QUERIES, OWN_CHUNK, ALIKE = 16_384, 8_192, 1_024, 1e-9
OWN = "query_id long, vector binary, own double, better long"


def _better_in_block(most: int, dim: int):
    """For applyInArrow on one block of documents and one of queries: how many documents go before each query's own."""

    def run(rows: pa.Table) -> pa.Table:
        side, ids, own = (rows.column(c).to_numpy() for c in ("side", "id", "own"))
        x = _matrix(rows.column("vector"), dim)
        docs, asked = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        better = rows.column("better").to_numpy()[asked]
        for lo in range(0, len(docs), OWN_CHUNK):
            at = np.flatnonzero(better < most)
            if not len(at):
                break
            part, of = docs[lo : lo + OWN_CHUNK], asked[at]
            score, own_score = x[of] @ x[part].T, own[of][:, None]
            above, least = score > own_score + ALIKE, score >= own_score - ALIKE
            better[at] += np.count_nonzero(above, axis=1)
            for row in np.flatnonzero(np.count_nonzero(least, axis=1) > np.count_nonzero(above, axis=1)):
                alike = least[row] & ~above[row]
                better[at[row]] += np.count_nonzero(ids[part[alike]] < ids[of[row]])
        before = rows.column("better").to_numpy()[asked]
        return pa.table({"query_id": pa.array(ids[asked], pa.int64()), "vector": rows.column("vector").take(pa.array(asked)), "own": pa.array(own[asked], pa.float64()), "better": pa.array(better - before, pa.int64())})

    return run


def own_places(queries: DataFrame, index: DataFrame, most: int, block: int = OWN_DOCS) -> DataFrame:
    """(query_id, rank): the place of the index's row with the query's own id by inner products, null beyond `most`.

    queries(query_id, vector), index(doc_id, vector), as for knn; scores within ALIKE are ties, by doc_id. A query is done
    once `most` rows stand before its own, so it meets one block of the index, the next eight if it is still open, and
    then all others. Both sides are met in blocks.
    """
    spark = queries.sparkSession
    dim = queries.where("vector is not null").agg(F.min_by(F.size("vector"), "query_id").alias("d")).first()["d"]
    if not dim:
        return queries.select(F.col("query_id").cast("long").alias("query_id"), F.lit(None).cast("int").alias("rank")).distinct()
    docs = written(_usable(index, "doc_id", dim))

    def scored(batches):
        for batch in batches:
            own = np.einsum("ij,ij->i", _matrix(batch.column("vector"), dim), _matrix(batch.column("mine"), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(own), pa.array(np.zeros(len(own), np.int64))], ["query_id", "vector", "own", "better"])

    mine = docs.select(F.col("doc_id").alias("query_id"), F.col("vector").alias("mine"))
    pairs = _usable(queries, "query_id", dim).join(mine, "query_id").select("query_id", "vector", "mine").mapInArrow(scored, OWN)
    still = written(pairs.groupBy("query_id", "vector").agg(F.max("own").alias("own"), F.max("better").alias("better")))
    parts = max(1, -(-docs.count() // block))
    each = lambda lo, hi: F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)))
    held = docs.select(F.lit(1).alias("side"), F.col("doc_id").alias("id"), "vector", F.lit(0.0).alias("own"), F.lit(0).cast("long").alias("better"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"))
    edges = sorted({0, 1, min(9, parts), parts})
    for lo, hi in zip(edges, edges[1:], strict=False):
        turns = max(1, -(-still.count() * (hi - lo) // (parts * OWN_QUERIES)))
        turn = F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(turns)).cast("int")
        met = still.select(F.lit(0).alias("side"), F.col("query_id").alias("id"), "vector", "own", "better", each(lo, hi).alias("by"), turn.alias("turn"))
        met = met.withColumn("part", ((F.pmod(F.xxhash64("id"), F.lit(parts)) + F.col("by")) % parts).cast("int")).drop("by").select("side", "id", "vector", "own", "better", "part", "turn")
        found = met.unionByName(held.withColumn("turn", each(0, turns))).groupBy("part", "turn").applyInArrow(_better_in_block(most, dim), OWN)
        before = still.select("query_id", "vector", "own", "better")
        still = written(before.union(found).groupBy("query_id", "vector", "own").agg(F.sum("better").alias("better")).where(F.col("better") < most))
    ranks = still.groupBy("query_id").agg((F.min("better") + 1).cast("int").alias("rank"))
    return queries.select(F.col("query_id").cast("long").alias("query_id")).where("query_id is not null").distinct().join(ranks, "query_id", "left")


#: Pairs of a query and its term up to this number go to where the documents are scanned; more are joined. Cells of a
#: table of scores (queries by documents) and sums that a task holds at once; how far scores may lie that round alike.
WANTED_TERMS, CELLS_AT_ONCE, SUMS_AT_ONCE, NEAR = 200_000, 1 << 21, 1 << 22, 2e-9
WORD = r"(?U)\w+"


def words(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, wanted_terms: int = WANTED_TERMS) -> DataFrame:
    """(query_id, doc_id, score, rank) by Okapi BM25. queries(query_id, text), docs(doc_id, text).

    Documents are read and cut into words once. The queries' terms, up to `wanted_terms` pairs of query and term, are
    broadcast: of a document there remains one row, its length and its counts of these terms, which is written, since
    counts and averages go over all of them; then each task scores the documents that it reads for all queries, and sends
    on those that can be among a query's k best. Rows that repeat a doc_id are one document then, as in SQL, and rows
    without one are found by nothing. More terms are joined, and scores summed by query and document.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).distinct()
    pairs = wanted.limit(wanted_terms + 1).toArrow()
    if pairs.num_rows > wanted_terms:
        return _joined(wanted, docs, k, k1, b)
    coded = pairs.column("term").combine_chunks().dictionary_encode()
    given = pairs.column("query_id").combine_chunks()
    places: dict[str, int] = {}
    asked = np.array([places.setdefault(repr(x), len(places)) for x in given.to_pylist()], np.int64)
    names = given.take(pa.array(np.unique(asked, return_index=True)[1]))
    n_terms, order = len(coded.dictionary), np.argsort(coded.indices.to_numpy(), kind="stable")
    first = np.searchsorted(coded.indices.to_numpy()[order], np.arange(n_terms + 1))
    spark, askers = queries.sparkSession, asked[order]
    terms = spark.sparkContext.broadcast(coded.dictionary.cast(pa.string()))

    def counted(batches):
        for batch in batches:
            lists = batch.column("words")
            at = pc.index_in(lists.flatten().cast(pa.string()), value_set=terms.value).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))[at >= 0]
            key, tf = np.unique(row * n_terms + at[at >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(key // max(1, n_terms), np.arange(len(lists) + 1)).astype(np.int32))
            held = (pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key % max(1, n_terms), tf))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists.value_lengths().cast(pa.int64()), *held], ["doc_id", "len", "at", "tf"])

    cut = docs.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("words"))
    schema = docs.select("doc_id", F.lit(0).cast("long").alias("len"), *(F.array(F.lit(0)).alias(c) for c in ("at", "tf"))).schema
    hits = written(cut.mapInArrow(counted, schema))
    n, total = hits.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    if hits.groupBy("doc_id").count().where("count > 1").limit(1).count():
        both = hits.groupBy("doc_id").agg(F.sum("len").alias("len"), F.collect_list(F.struct("at", "tf")).alias("held"))
        hits = written(both.select("doc_id", "len", F.flatten("held.at").alias("at"), F.flatten("held.tf").alias("tf")))
    by = hits.select(F.explode(F.array_distinct("at")).alias("at")).groupBy("at").count().toArrow()  # a row a term
    df = np.zeros(n_terms)
    df[by.column("at").to_numpy()] = by.column("count").to_numpy()
    idf, average = np.log(1 + (n - df + 0.5) / (df + 0.5)), total / max(1, n) or 1.0
    shared = spark.sparkContext.broadcast((first, askers, idf, names))

    def scored(batches):
        first, askers, idf, names = shared.value
        reached = np.zeros(len(names))
        for whole in batches:
            step = max(1, CELLS_AT_ONCE // max(1, len(names)))
            for batch in (whole.slice(lo, step) for lo in range(0, whole.num_rows, step)):
                lists, length = batch.column("at"), batch.column("len").to_numpy()
                row = np.repeat(np.arange(len(length)), lists.value_lengths().to_numpy(zero_copy_only=False))
                key, back = np.unique(row * n_terms + lists.flatten().to_numpy(), return_inverse=True)
                row, at, tf = key // max(1, n_terms), key % max(1, n_terms), np.bincount(back, batch.column("tf").flatten().to_numpy(), len(key))
                part = idf[at] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / average))
                count = first[at + 1] - first[at]
                score, group = np.zeros(len(names) * len(length)), np.cumsum(count) // SUMS_AT_ONCE
                for g in np.unique(group):
                    lo, hi = np.searchsorted(group, [g, g + 1])
                    own, c = np.arange(lo, hi), count[lo:hi]
                    of = np.repeat(own, c)
                    who = askers[np.repeat(first[at[own]] - np.cumsum(c) + c, c) + np.arange(len(of))]
                    np.add.at(score, who * len(length) + row[of], part[of])
                score = score.reshape(len(names), len(length))
                if len(length) >= k:
                    reached = np.maximum(reached, np.partition(score, -k, axis=1)[:, -k])
                query, doc = np.nonzero((score > 0) & (score >= reached[:, None] - NEAR))
                value, place = score[query, doc], pc.sort_indices(batch.column("doc_id")).to_numpy()
                rank = np.empty(len(place), np.int64)
                rank[place] = np.arange(len(place))
                by = np.lexsort((rank[doc], -value, query))  # of scores that are the same k documents suffice
                query, doc, value = query[by], doc[by], value[by]
                begins = np.flatnonzero((np.diff(query, prepend=-1) != 0) | (np.diff(value, prepend=-1.0) != 0))
                nth = np.arange(len(query)) - np.repeat(begins, np.diff(np.append(begins, len(query))))
                query, doc, value = query[nth < k], doc[nth < k], value[nth < k]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), batch.column("doc_id").take(pa.array(doc)), pa.array(value)], ["query_id", "doc_id", "score"])

    schema = queries.select("query_id").schema.fields + docs.select("doc_id").schema.fields
    found = StructType([*schema, StructField("score", DoubleType())])
    return _ranked(hits.where("doc_id is not null and size(at) > 0").mapInArrow(scored, found), k)


def _joined(wanted: DataFrame, docs: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """bm25 of any number of wanted(query_id, term): of documents there remain the terms that some query has, with their
    counts, and an empty term that stands for the document and its length."""
    terms = wanted.select("term").union(wanted.sparkSession.range(1).select(F.lit(""))).distinct()
    held = docs.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("words"))
    rows = held.select("doc_id", F.size("words").alias("len"), F.explode(F.array_append("words", F.lit(""))).alias("term")).join(terms, "term")
    hits = written(rows.groupBy("term", "doc_id", "len").agg(F.count("*").alias("tf")))
    stats = hits.where("term = ''").agg(F.sum("tf").alias("n"), (F.sum(F.col("len") * F.col("tf")) / F.sum("tf")).alias("avg"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    scored = hits.join(df, "term").crossJoin(F.broadcast(stats)).select("term", "doc_id", part.alias("part"))
    return _ranked(wanted.join(scored, "term").groupBy("query_id", "doc_id").agg(F.sum("part").alias("score")), k)


#: Most candidates of each kind, and how many more of both where a search is broadened.
DENSE_CAP, LEXICAL_CAP, BROADER = 30, 15, 4


def hybrid(dense: DataFrame, lexical: DataFrame, dense_cap: int | None = DENSE_CAP, lexical_cap: int | None = LEXICAL_CAP, broaden: int = 0) -> DataFrame:
    """The best dense hits, then the best lexical ones that are not among them, with their place; caps of None take all."""
    capped = [df if cap is None else df.where(F.col("rank") <= cap + broaden) for df, cap in ((dense, dense_cap), (lexical, lexical_cap))]
    both = capped[0].select("query_id", "doc_id", "rank", F.lit(0).alias("list")).union(capped[1].select("query_id", "doc_id", "rank", F.lit(1).alias("list")))
    first = keep_first(both, ["query_id", "doc_id"], ["list", "rank"])
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("list", "rank"))).select("query_id", "doc_id", "place")


def interleave(lists: DataFrame, cap: int = 18) -> DataFrame:
    """Round-robin over ranked lists (query_id, list, rank, doc_id): by rank, then list; repeats go; cap a query."""
    first = keep_first(lists, ["query_id", "doc_id"], ["rank", "list"])
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "list"))).where(F.col("place") <= cap).select("query_id", "doc_id", "place")


def gold_index(pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """pairs(query_id, positive) with the index of the positive in corpus(idx, text); of equal texts the last."""
    return pairs.join(corpus.groupBy("text").agg(F.max("idx").alias("gold")), F.col("positive") == F.col("text"), "inner").select("query_id", "gold")


def missing_positives(pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    return pairs.select(F.col("positive").alias("text")).distinct().join(corpus.select("text"), "text", "left_anti")


#: Most candidates of a query that are scored.
RERANKED = 50


def rerank(candidates: DataFrame, scorer, k: int) -> DataFrame:
    """candidates(query_id, query, doc_id, text, place) by a Python scorer of text pairs, in Arrow batches; k a query.

    Only the first RERANKED places are scored, each by its whole text and query. Scores alike in nine digits are ties, which places break. Where the scorer
    fails, its candidates keep their places' order.
    """

    @F.pandas_udf("double")
    def score(queries: pd.Series, texts: pd.Series) -> pd.Series:
        try:
            return pd.Series(scorer.score(queries, texts), dtype="float64")
        except Exception:  # whatever a scorer raises: the order of the candidates stands
            return pd.Series([None] * len(queries), dtype="float64")

    out = candidates.where(F.col("place") <= RERANKED).withColumn("score", score("query", "text"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc_nulls_last(), "place"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def with_texts(pairs: DataFrame, docs: DataFrame, most: int = WANTED_TERMS) -> DataFrame:
    """pairs(query_id, doc_id, ..) with the text of docs(doc_id, text).

    Up to `most` pairs go to where the documents are scanned, so that of their texts only those that are wanted move; more
    are met by Spark's own choice of join. The pairs are written once.
    """
    held = written(pairs)
    few = held.limit(most + 1).count() <= most
    return docs.select("doc_id", "text").join(F.broadcast(held) if few else held, "doc_id")


def by_index(results: DataFrame, documents: str = "documents", index: str = "index") -> DataFrame:
    """results with the text that each one's index (from 0) points to in its array of documents; null where there is none."""
    return results.withColumn("text", F.get(documents, F.col(index)))


def side_by_side(a: DataFrame, b: DataFrame, order: list[str], columns: list[str], cap: int = 15) -> DataFrame:
    """(place, the columns of both as a_ and b_): the first rows of each in this order, one beside the other by place."""
    numbered = [df.orderBy(*order).limit(cap).select(F.row_number().over(Window.orderBy(*order)).alias("place"), *(F.col(c).alias(f"{p}_{c}") for c in columns)) for p, df in (("a", a), ("b", b))]
    return numbered[0].join(numbered[1], "place")


def grounding(queries: DataFrame, docs: DataFrame, cap: int = 18, dense_k: int = 15, answer_k: int = 15, query_k: int = 10) -> DataFrame:
    """(query_id, doc_id, place): documents to judge an answer by, in turn from four ranked lists, at most `cap`.

    queries(query_id, query, answer, query_vector, answer_vector), docs(doc_id, text, vector). The lists are dense hits
    of the query, dense hits of the answer, lexical hits of the answer and lexical hits of the query. Vectors and queries
    are written once, since the dense searches read them several times; both lexical lists come from one search.
    """
    queries, vectors = written(queries), written(docs.select("doc_id", "vector"))
    vector = lambda c: queries.select("query_id", F.col(c).alias("vector"))
    text = lambda i, c: queries.select(F.struct("query_id", F.lit(i).alias("list")).alias("query_id"), F.col(c).alias("text"))
    dense = [knn(vector(c), vectors, dense_k).select("query_id", F.lit(i).alias("list"), "rank", "doc_id") for i, c in enumerate(("query_vector", "answer_vector"))]
    lexical = bm25(text(2, "answer").union(text(3, "query")), docs, max(answer_k, query_k)).select("query_id.*", "rank", "doc_id")
    lists = [*dense, lexical.where(F.col("rank") <= F.when(F.col("list") == 2, answer_k).otherwise(query_k))]
    out = lists[0]
    for df in lists[1:]:
        out = out.union(df)
    return interleave(out, cap)
