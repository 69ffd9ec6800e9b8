"""A persisted inverted index for BM25: parts that are replaced whole, blocks of postings with maxima, top-k that skips blocks.

Below the index's path lie postings (a row for each term and block of up to BLOCK documents) and docs (a row for each
document), both in one folder for each part. A part is a batch or a source: writing it again replaces it. A block's postings
lie one after another in one file, so that a search scores them where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from tesserae.operators.records import numbered
from tesserae.operators.retrieve import CELLS_AT_ONCE, NEAR, SUMS_AT_ONCE, words
from tesserae.operators.written import deleted, meanwhile, pieces, tidied, written

#: Documents of one block; blocks of a query that are scored first; terms of queries that are broadcast; blocks that are.
BLOCK, FIRST, BROADCAST_TERMS, BROADCAST_BLOCKS = 128, 8, 200_000, 500_000
#: Words of the documents that one task makes into blocks, one block at least, and rows of the index that it gives at once.
RANGE_WORDS, ROWS_AT_ONCE = 1 << 21, 4096
HELD = "row long, doc_id long, len int, terms string, counts array<int>"
POSTINGS = "term string, block long, n long, best array<struct<tf:int,shortest:int>>, postings array<struct<doc_id:long,tf:int,len:int,at:long>>"


def _ends(groups: np.ndarray, n: int) -> pa.Array:
    """Offsets of n lists from the sorted numbers of the list that each value is of."""
    return pa.array(np.searchsorted(groups, np.arange(n + 1)).astype(np.int32))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """HELD of (row, doc_id, words): a document's terms, which hold no blank, in one string, and how often each occurs."""
    for whole in batches:
        joined = pc.binary_join(whole.column("words").cast(pa.list_(pa.string())), " ")
        for lo, hi in pieces(joined):
            batch = whole.slice(lo, hi - lo)
            lists = batch.column("words")
            coded = lists.flatten().cast(pa.string()).dictionary_encode()
            n = max(1, len(coded.dictionary))
            key, tf = np.unique(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)) * n + coded.indices.to_numpy(), return_counts=True)
            ends = _ends(key // n, len(lists))
            terms = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(key % n)))
            counts = pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), lists.value_lengths(), pc.binary_join(terms, " "), counts], ["row", "doc_id", "len", "terms", "counts"])


def _blocks(table: pa.Table, before: int, block: int) -> Iterator[pa.RecordBatch]:
    """POSTINGS of documents in the order of their numbers, of which the first comes after `before` others."""
    length, doc_id, counts = (table.column(c).combine_chunks() for c in ("len", "doc_id", "counts"))
    n = counts.value_lengths().to_numpy()
    coded = pc.split_pattern(table.column("terms").combine_chunks().cast(pa.string()).filter(pa.array(n > 0)), " ").flatten().dictionary_encode()
    doc, tf = np.repeat(np.arange(len(n)), n), counts.flatten().to_numpy()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key = doc // block * max(1, len(order)) + rank[coded.indices.to_numpy()]
    by = np.argsort(key, kind="stable")
    doc, tf, key = doc[by], tf[by], key[by]
    begins = np.flatnonzero(np.diff(key, prepend=-1))
    group, n_rows = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(key)))), len(begins)
    length, doc_id = length.to_numpy()[doc], doc_id.to_numpy()[doc]
    postings = pa.StructArray.from_arrays([pa.array(doc_id), pa.array(tf), pa.array(length), pa.array(before + doc + 1)], ["doc_id", "tf", "len", "at"])
    same = np.lexsort((length, tf, group))  # of each count the shortest document comes first
    same = same[(np.diff(group[same], prepend=-1) != 0) | (np.diff(tf[same], prepend=-1) != 0)]
    best = pa.StructArray.from_arrays([pa.array(tf[same]), pa.array(length[same])], ["tf", "shortest"])
    out = pa.RecordBatch.from_arrays(
        [
            coded.dictionary.take(pa.array(order)).take(pa.array(key[begins] % max(1, len(order)))), pa.array(before // block + key[begins] // max(1, len(order))), pa.array(np.bincount(group, minlength=n_rows)),
            pa.ListArray.from_arrays(_ends(group[same], n_rows), best), pa.ListArray.from_arrays(_ends(group, n_rows), postings),
        ],
        ["term", "block", "n", "best", "postings"],
    )
    yield from (out.slice(lo, ROWS_AT_ONCE) for lo in range(0, n_rows, ROWS_AT_ONCE))


def _cuts(held: DataFrame, block: int) -> np.ndarray:
    """Numbers of documents, of whole blocks, after which a range of the order by length ends; the driver sees a row a length."""
    by = held.groupBy("len").count().toArrow().sort_by("len")
    length, docs = (by.column(c).to_numpy().astype(np.int64) for c in ("len", "count"))
    weight = length + 8  # a document is work too
    upto, total = np.cumsum(docs * weight), int(docs.sum())
    targets = np.arange(1, -(-int((docs * weight).sum()) // RANGE_WORDS)) * RANGE_WORDS
    i = np.searchsorted(upto, targets)
    at = np.cumsum(docs)[i] - (upto[i] - targets) // weight[i]
    cuts = np.unique(at // block * block)
    return cuts[(cuts > 0) & (cuts < total)]


def write_part(docs: DataFrame, path: str, part: str, block: int = BLOCK) -> None:
    """Index docs(doc_id, text) as one part of the index, in place of what that part held.

    Blocks hold documents of like length. For each count of a term that occurs in a block its shortest document is kept
    (best), from which the largest part that the term can give there follows, whatever the average length will be. Documents
    are numbered by ids and lengths alone; from these numbers follow ranges of whole blocks and like numbers of words, to
    which the documents' terms and counts are dealt once. A task has one range and gives its blocks one after another, so
    postings are not shuffled. The terms and counts are written once and deleted again.
    Rows without doc_id are left out, null texts have no words; of rows that repeat a doc_id each is a document.
    """
    spark = docs.sparkSession
    cut = docs.where("doc_id is not null").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words(F.coalesce("text", F.lit(""))).alias("words"))
    with tidied(spark), meanwhile(cut.mapInArrow(_counted, HELD)) as held:
        cuts = _cuts(held, block)
        starts, edges = np.append(0, cuts), np.zeros((0, 3), np.int64)
        if len(cuts):
            order = ["len", "doc_id", "row"]
            firsts = spark.createDataFrame([(int(c) + 1,) for c in cuts], "at long")
            found = numbered(held.select(*order), order, "at").join(F.broadcast(firsts), "at").orderBy("at").select(*order).collect()  # a row a range
            edges = np.array(found, np.int64)

        @F.arrow_udf("int")
        def range_of(length: pa.Array, doc_id: pa.Array, row: pa.Array) -> pa.Array:
            keys = [np.concatenate([edges[:, i], x.to_numpy().astype(np.int64)]) for i, x in enumerate((length, doc_id, row))]
            by = np.lexsort(keys[::-1])  # a range's first document is its edge, and edges come before rows that are alike
            out = np.empty(len(by), np.int32)
            out[by] = np.cumsum(by < len(edges))
            return pa.array(out[len(edges) :])

        def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest, before = None, 0
            for batch in batches:
                if rest is None:
                    before = int(starts[batch.column("range")[0].as_py()])
                table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
                whole = len(table) // block * block
                if whole:
                    yield from _blocks(table.slice(0, whole), before, block)
                rest, before = table.slice(whole), before + whole
            if rest is not None and len(rest):
                yield from _blocks(rest, before, block)

        held.select("doc_id", "len").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/docs/part={part}")
        dealt = held.withColumn("range", range_of("len", "doc_id", "row") if len(cuts) else F.lit(0)).repartitionById(len(starts), "range")
        rows = dealt.sortWithinPartitions("len", "doc_id", "row").mapInArrow(built, POSTINGS)
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings/part={part}")


def drop_part(spark: SparkSession, path: str, part: str) -> None:
    for kind in ("docs", "postings"):
        deleted(spark, f"{path}/{kind}/part={part}")


def index_stream(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every batch of a streaming docs(doc_id, text) becomes a part; a batch that is run again replaces its own."""
    out = docs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return out.foreachBatch(lambda df, batch: write_part(df, path, f"batch-{batch}")).start()


def _part_score(tf: Column, length: Column, k1: float, b: float) -> Column:
    return F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.col("avg")))


def _few(df: DataFrame, most: int) -> DataFrame:
    """df to be broadcast where it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def plan_search(spark: SparkSession, path: str, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, terms, bounds): the index's rows; (query_id, term, idf, avg); (query_id, part, block, bound).

    bound is above every score in the block: the sum of its terms' largest possible parts. Only the blocks' numbers are
    read for it, no postings.
    """
    postings = spark.read.parquet(f"{path}/postings").withColumn("part", F.col("part").cast("string"))
    wanted = written(queries.where("query_id is not null").select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).distinct())
    counts = postings.select("term", "n").join(_few(wanted.select("term").distinct(), BROADCAST_TERMS), "term")
    stats = spark.read.parquet(f"{path}/docs").agg(F.count("*").alias("docs"), F.avg("len").alias("avg"))
    df = counts.groupBy("term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(stats))
    terms = written(wanted.join(df.select("term", "avg", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "term").select("query_id", "term", "idf", "avg"))
    top = F.array_max(F.transform("best", lambda x: _part_score(x["tf"], x["shortest"], k1, b)))
    tops = postings.select("term", "part", "block", "best").join(_few(terms.select("term", "idf", "avg").distinct(), BROADCAST_TERMS), "term").select("term", "part", "block", top.alias("top"))
    bounds = tops.join(_few(terms.select("query_id", "term"), BROADCAST_TERMS), "term").groupBy("query_id", "part", "block").agg((F.sum("top") * (1 + 1e-9)).alias("bound"))
    return postings, terms, written(bounds)


def score_blocks(postings: DataFrame, terms: DataFrame, blocks: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, least: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) of documents in blocks(query_id, part, block), in which all queries are scored.

    What cannot be among a query's k best is left out: what is below least(query_id, least), or below the k-th best that the
    same task has seen. Up to BROADCAST_TERMS pairs of query and term a block is scored where it is read, and no posting
    moves; a block that several tasks read gives sums that are added. More pairs are joined.
    """
    spark = postings.sparkSession
    hits = postings.select("part", "block", "term", "postings").join(_few(terms.select("term").distinct(), BROADCAST_TERMS), "term")
    asked = blocks.select("part", "block").distinct()
    pairs = terms.limit(BROADCAST_TERMS + 1).toArrow()
    if pairs.num_rows > BROADCAST_TERMS:
        each = hits.join(asked, ["part", "block"]).join(terms, "term").select("query_id", "part", "idf", "avg", F.explode("postings").alias("p"))
        by = each.groupBy("query_id", "part", F.col("p.at").alias("at"), F.col("p.doc_id").alias("doc_id"))
        return by.agg(F.sum(_part_score(F.col("p.tf"), F.col("p.len"), k1, b)).alias("score")).select("query_id", "doc_id", "score")
    asked = written(hits.groupBy("part", "block").agg(F.count("*").alias("rows")).join(asked, ["part", "block"]).withColumn("run", F.monotonically_increasing_id()))
    coded = pairs.column("term").combine_chunks().cast(pa.string()).dictionary_encode()
    names = pairs.column("query_id").combine_chunks().dictionary_encode()
    order = np.argsort(coded.indices.to_numpy(), kind="stable")
    first = np.searchsorted(coded.indices.to_numpy()[order], np.arange(len(coded.dictionary) + 1))
    idf, avg = (pairs.column(c).to_numpy()[order[first[:-1]]] for c in ("idf", "avg"))
    reached = np.zeros(len(names.dictionary))
    if least is not None:
        known = least.select("query_id", "least").toArrow()  # a row a query
        place = pc.index_in(known.column("query_id").combine_chunks(), value_set=names.dictionary)
        reached[place.drop_null().to_numpy()] = known.column("least").combine_chunks().filter(place.is_valid()).to_numpy()
    shared = spark.sparkContext.broadcast((coded.dictionary, names.dictionary, first, names.indices.to_numpy()[order], idf, avg, reached))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, ids, first, askers, idf, avg, least = shared.value
        reached = least.copy()

        def of(table: pa.Table) -> Iterator[pa.RecordBatch]:
            """Scores of the documents of whole runs of rows, a run for each block."""
            run, n_rows, lists = table.column("run").to_numpy(), table.column("rows").to_numpy(), table.column("postings").combine_chunks()
            code = pc.index_in(table.column("term").combine_chunks().cast(pa.string()), value_set=vocabulary).to_numpy()
            nth = np.cumsum(np.diff(run, prepend=run[0]) != 0)
            entire = (np.bincount(nth) == n_rows[np.flatnonzero(np.diff(nth, prepend=-1))])[nth]
            row, flat = np.repeat(np.arange(len(run)), lists.value_lengths().to_numpy()), lists.flatten()
            at, doc_id, tf, length = (flat.field(c).to_numpy() for c in ("at", "doc_id", "tf", "len"))
            code, low = code[row], at.min()
            _, one, doc = np.unique(nth[row] * (at.max() - low + 1) + at - low, return_index=True, return_inverse=True)
            part = idf[code] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg[code]))
            by = np.argsort(doc, kind="stable")
            code, part, doc = code[by], part[by], doc[by]
            step = max(1, CELLS_AT_ONCE // max(1, len(ids)))
            for lo in range(0, len(one), step):
                mine = one[lo : lo + step]
                here = slice(*np.searchsorted(doc, [lo, lo + step]))
                c, d, p, width = code[here], doc[here] - lo, part[here], len(mine)
                count, score = first[c + 1] - first[c], np.zeros(len(ids) * width)
                group = np.cumsum(count) // SUMS_AT_ONCE
                for g in np.unique(group):
                    these = slice(*np.searchsorted(group, [g, g + 1]))
                    n = count[these]
                    each = np.repeat(np.arange(len(n)), n)
                    who = askers[np.repeat(first[c[these]] - np.cumsum(n) + n, n) + np.arange(len(each))]
                    score += np.bincount(who * width + d[these][each], p[these][each], len(score))
                score, known = score.reshape(len(ids), width), entire[row[mine]]
                if known.sum() >= k:
                    np.maximum(reached, np.partition(score[:, known], -k, axis=1)[:, -k], out=reached)
                query, place = np.nonzero((score > 0) & ((score >= reached[:, None] - NEAR) | ~known))
                value, doc_of = score[query, place], doc_id[mine]
                sort = np.lexsort((doc_of[place], -value, ~known[place], query))  # of scores that are the same k documents suffice
                query, place, value = query[sort], place[sort], value[sort]
                starts = np.flatnonzero((np.diff(query, prepend=-1) != 0) | (np.diff(value, prepend=-1.0) != 0) | np.diff(known[place], prepend=False))
                alike = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
                keep = (alike < k) | ~known[place]
                query, place, value = query[keep], place[keep], value[keep]
                out = (ids.take(pa.array(query)), pa.array(run[row[mine]][place]), pa.array(at[mine][place]), pa.array(doc_of[place]), pa.array(value))
                yield pa.RecordBatch.from_arrays(list(out), ["query_id", "run", "at", "doc_id", "score"])

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            run = table.column("run").to_numpy()
            last = int(np.flatnonzero(np.diff(run, prepend=run[0] - 1))[-1])
            if last:
                yield from of(table.slice(0, last))
            rest = table.slice(last)
        if rest is not None:
            yield from of(rest)

    met = _few(asked, BROADCAST_BLOCKS)
    rows = hits.join(met, ["part", "block"]).select("run", "rows", "term", "postings")
    if met is asked:
        rows = rows.repartition("run").sortWithinPartitions("run")
    schema = StructType([terms.schema["query_id"], *(StructField(f.name, f.dataType) for f in spark.createDataFrame([], "run long, at long, doc_id long, score double").schema)])
    return rows.mapInArrow(scored, schema).groupBy("query_id", "run", "at", "doc_id").agg(F.sum("score").alias("score")).select("query_id", "doc_id", "score")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best documents of the index by Okapi BM25, as retrieve.bm25 gives them.

    The FIRST blocks of a query by their bounds are scored; whatever block cannot reach the k-th best score found there is
    skipped, the others are scored too. A blank query finds nothing, an index that is not there neither.
    """
    by_score = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    with tidied(spark):
        try:
            postings, terms, bounds = plan_search(spark, path, queries, k1, b)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "part", "block"))
        first = written(bounds.withColumn("place", place).where(F.col("place") <= FIRST).select("query_id", "part", "block"))
        found = written(score_blocks(postings, terms, first, k, k1, b))
        least = written(found.withColumn("rank", by_score).where(F.col("rank") == k).select("query_id", F.round("score", 9).alias("least")))
        rest = bounds.join(first.select("part", "block").distinct(), ["part", "block"], "left_anti").join(least, "query_id", "left").where("least is null or bound + 1e-9 >= least")
        out = found.unionByName(score_blocks(postings, terms, rest.select("query_id", "part", "block"), k, k1, b, least))
    return out.withColumn("rank", by_score).where(F.col("rank") <= k)
