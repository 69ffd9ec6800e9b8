"""Passages that repeat across documents, found from minimiser suffixes and the windows that they were retained for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import U64, Words, bloom, chunks, cut, discard, hidden, mix, texts_of

#: A passage of MIN_WORDS words holds WINDOW grams of GRAM words, so at least one of its suffixes is retained.
MIN_WORDS, GRAM = 50, 16
WINDOW = MIN_WORDS - GRAM + 1
#: Suffixes of a gram that one task compares; more frequent grams are split by document into SALTS parts or more, so that
#: a part has about SALT_ROWS suffixes of a gram at most. A document of more than BLOCK words is split like several.
SALT_ROWS, SALTS, BLOCK = 4096, 64, 1 << 16
#: Most grams that are split; where more have above SALT_ROWS suffixes, the bound rises so that the most frequent ones are.
SPLIT_GRAMS = 4_000_000


def _slide(a: np.ndarray, width: int, fn) -> np.ndarray:
    """fn (np.minimum or np.maximum) over each `width` consecutive values."""
    span, out = 1, a
    while span * 2 <= width:
        out = fn(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return fn(out[: len(out) - rest], out[rest:]) if rest else out


def suffixes(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, count, gram hash) of the retained suffixes: each is the leftmost least gram of some window of its text.

    Those windows start at the words first, ..., first + count - 1, and every window of a text belongs to one suffix.
    """
    grams = words.grams(GRAM)
    m = len(grams) - WINDOW + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    mask = (1 << 22) - 1
    key = (grams >> U64(22) << U64(22)) | (np.arange(len(grams), dtype=U64) & U64(mask))
    least = _slide(key, WINDOW, np.minimum)
    crosses = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(crosses, words.first[1:-1], 1)
    seen = np.cumsum(crosses)
    at = np.arange(m)
    at = at[seen[at + MIN_WORDS - 1] == seen[at]]
    suffix = at + (((least[at] & U64(mask)).astype(np.int64) - at) & mask)
    starts = np.flatnonzero((np.diff(suffix, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 1))
    return at[starts], np.diff(np.append(starts, len(at))), grams[suffix[starts]]


def _binary(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> pa.Array:
    """values[first : first + count] of each pair as bytes."""
    ends = np.concatenate([[0], np.cumsum(count)])
    flat = values[np.repeat(first - ends[:-1], count) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(flat)])


OCCURRENCE = "gram long, doc_id long, text_key long, pos int, windows binary"
SPAN = "doc_id long, text_key long, spans array<struct<lo:int,hi:int>>, sources array<long>"


def _unpacked(rows: pa.Table):
    """(occurrence, number within it, hash) of each window, and each occurrence's rank by (doc_id, text_key)."""
    windows = rows.column("windows").to_pylist()
    count = np.fromiter(map(len, windows), np.int64, len(windows)) // 8
    owner = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    doc, text = rows.column("doc_id").to_numpy(), rows.column("text_key").to_numpy()
    order = np.lexsort((text, doc))
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], (np.diff(doc[order]) != 0) | (np.diff(text[order]) != 0)])[: len(doc)])
    return owner, nth, np.frombuffer(b"".join(windows), U64), rank


def _later(rows: pa.Table) -> pa.RecordBatch:
    """A SPAN row for each document: its windows that an earlier document among the rows holds too, and the first such."""
    owner, nth, window, rank = _unpacked(rows)
    doc, text, pos = (rows.column(c).to_numpy() for c in ("doc_id", "text_key", "pos"))
    order = np.argsort(window)
    group = np.cumsum(np.diff(window[order], prepend=window[order][:1]) != 0)
    head = np.empty(len(order), np.int64)
    head[order] = np.minimum.reduceat(rank[owner[order]], np.flatnonzero(np.diff(group, prepend=-1)))[group]
    at = np.flatnonzero(rank[owner] != head)
    own, word = rank[owner[at]], pos[owner[at]] + nth[at]
    order = np.lexsort((word, own))
    by, word = own[order], word[order]
    starts = np.flatnonzero((np.diff(by, prepend=-1) != 0) | (np.diff(word, prepend=0) > MIN_WORDS))
    lo, hi = word[starts], word[np.append(starts, len(word))[1:] - 1] + MIN_WORDS
    spans = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (lo, hi)], ["lo", "hi"])
    pairs = np.unique(np.stack([own, head[at]], axis=1), axis=0)
    docs = np.unique(own)
    doc_of, text_of = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    doc_of[rank], text_of[rank] = doc, text
    lists = [pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(key, docs), len(key)).astype(np.int32)), values) for key, values in ((by[starts], spans), (pairs[:, 0], pa.array(doc_of[pairs[:, 1]])))]
    return pa.RecordBatch.from_arrays([pa.array(doc_of[docs]), pa.array(text_of[docs]), *lists], ["doc_id", "text_key", "spans", "sources"])


def _first(rows: pa.Table) -> pa.RecordBatch:
    """For each gram and salt among the rows and each distinct window there: the first document that holds it."""
    owner, _, window, rank = _unpacked(rows)
    gram, salt, doc, text = (rows.column(c).to_numpy() for c in ("gram", "salt", "doc_id", "text_key"))
    group = np.cumsum((np.diff(gram, prepend=gram[:1]) != 0) | (np.diff(salt, prepend=salt[:1]) != 0))[owner]
    order = np.lexsort((rank[owner], window, group))
    pick = order[np.concatenate([[True], (np.diff(window[order]) != 0) | (np.diff(group[order]) != 0)])[: len(order)]]
    own, one = owner[pick], np.ones(len(pick), np.int64)
    columns = [pa.array(c[own]) for c in (gram, salt, doc, text)]
    return pa.RecordBatch.from_arrays([*columns, _binary(window, pick, one)], ["gram", "salt", "doc_id", "text_key", "windows"])


def _by_group(batches, keys: tuple[str, ...], fn):
    """fn of tables of rows sorted by the keys; rows with equal keys are never split over two tables."""

    def changes(rows):
        return np.flatnonzero(np.any([np.diff(rows.column(k).to_numpy()) != 0 for k in keys], axis=0)) + 1

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < 20_000:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        ends = changes(rows)
        last = int(ends[-1]) if len(ends) else 0
        if last:
            yield fn(rows.slice(0, last))
        held, n = rows.slice(last).to_batches(), rows.num_rows - last
    if held:
        yield fn(pa.Table.from_batches(held).combine_chunks())


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans, sources) for docs(doc_id, text): words lo..hi-1 of each span repeat in the sources.

    A passage is MIN_WORDS words or more between ASCII white space, byte for byte. The first document that holds it, by
    doc_id, is not reported; within one document nothing is. A document may have several rows with spans that overlap.
    Null and empty texts and rows without doc_id have none; rows that repeat doc_id and text are one document (text_key = xxhash64 of the text).

    Two scans: the first counts the hashes of the retained suffixes' grams, the second emits each suffix with a repeated
    hash and the 64-bit hashes of the windows of MIN_WORDS words that it was retained for. Equal windows retain equal
    grams, so all documents that hold a window meet in its gram's group; each window but the first document's is
    reported. A longer passage is the union of its windows. Where grams have more than SALT_ROWS suffixes, the suffixes are
    written once (a row each, however often their grams come), and those grams are split over tasks; what comes first in
    each part is compared over all parts and given back to them, so the results do not depend on the split.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    spark = docs.sparkSession

    def hashes(batches):
        for batch in chunks(batches, "text"):
            _, _, gram = suffixes(Words(texts_of(batch), fold=False))
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64))], ["gram"])

    often = docs.select("text").mapInArrow(hashes, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    often = cut(often)
    size = often.agg(F.count("*").alias("grams"), F.coalesce(F.sum("n"), F.lit(0)).alias("suffixes"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    wanted = spark.sparkContext.broadcast(bloom(often.select("gram"), size["grams"]))
    bound = max(SALT_ROWS, size["suffixes"] // SPLIT_GRAMS)
    most = often.where(F.col("n") > bound).select("gram").toArrow().column("gram").to_numpy()  # SPLIT_GRAMS at most
    discard(often)
    salts = max(SALTS, -(-size["most"] // bound))
    frequent = spark.sparkContext.broadcast(np.sort(most))

    def occurrences(batches):
        for batch in chunks(batches, "text"):
            words = Words(texts_of(batch), fold=False)
            first, count, gram = suffixes(words)
            hit = wanted.value.has(gram.view(np.int64))
            first, count, gram = first[hit], count[hit], gram[hit].view(np.int64)
            if not len(gram):
                continue
            text = np.searchsorted(words.first[1:], first, side="right")
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False)[text] for c in ("doc_id", "text_key"))
            windows = _binary(words.grams(MIN_WORDS), first, count)
            pos = first - words.first[text]
            part = mix(keys.astype(np.int64).view(U64) ^ mix(ids.astype(np.int64).view(U64), 31), 32) + (pos // BLOCK).astype(U64)
            salt = np.where(np.isin(gram, frequent.value), (part % U64(salts)).astype(np.int64), -1)
            columns = [pa.array(gram), pa.array(ids), pa.array(keys), pa.array(pos.astype(np.int32)), windows, pa.array(salt)]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "doc_id", "text_key", "pos", "windows", "salt"])

    rows = docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(occurrences, f"{OCCURRENCE}, salt long")
    dealt = lambda rows: rows.repartition("gram", "salt").sortWithinPartitions("gram", "salt")
    later = lambda rows: dealt(rows).mapInArrow(lambda b: _by_group(b, ("gram", "salt"), _later), SPAN)
    if not len(most):
        return later(rows)
    rows = cut(rows)
    firsts = dealt(rows.where("salt >= 0")).mapInArrow(lambda b: _by_group(b, ("gram", "salt"), _first), "gram long, salt long, doc_id long, text_key long, windows binary")
    firsts = firsts.groupBy("gram", "windows").agg(F.min(F.struct("doc_id", "text_key")).alias("f"), F.collect_list("salt").alias("salts")).where(F.size("salts") > 1)
    firsts = firsts.select("gram", "f.doc_id", "f.text_key", F.lit(-1).alias("pos"), "windows", F.explode("salts").alias("salt"))
    return later(rows.union(firsts))


def merged_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans, sources): the repeated word spans of each document, overlapping ones merged."""
    spans = repeated_passages(docs).groupBy("doc_id", "text_key").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    last = lambda acc: F.element_at(acc, -1)
    joined = F.aggregate(
        "s",
        F.expr("cast(array() as array<struct<lo:int,hi:int>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1)["hi"], F.lit(-1)) >= x["lo"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.get(acc, F.size(acc) - 1)["lo"].alias("lo"), F.greatest(F.get(acc, F.size(acc) - 1)["hi"], x["hi"]).alias("hi")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))))),
    )
    return spans.select("doc_id", "text_key", joined.alias("spans"), "sources")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with every repeated passage cut from its text but for the first document's; other columns stay.

    A cut takes the words and the white space after them. n_chars, where there is one, follows the new text. Documents
    that the cuts leave without a word stay as rows with an empty text. Null texts, rows without doc_id, repeated rows
    and columns of any other name stay as they are; an empty table gives an empty one.
    """
    columns = docs.columns
    doc, key, cuts_of = hidden(columns, "doc", "key", "cuts")
    found = merged_passages(docs).select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("spans").alias(cuts_of))
    joined = docs.join(found, (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left").drop(doc, key)

    def apply(batches):
        for batch in batches:
            spans = batch.column(cuts_of).to_pylist()
            if not any(spans):
                yield batch.select(columns)
                continue
            texts = batch.column("text").to_pylist()
            for i, cuts in enumerate(spans):
                if cuts:
                    raw = texts[i].encode()
                    words = Words([raw], fold=False)
                    start = np.append(words.start, len(raw) + 1) - 1
                    keep, at = [], 0
                    for c in cuts:
                        keep.append(raw[at : start[c["lo"]]])
                        at = start[c["hi"]] if c["hi"] < len(start) else len(raw)
                    texts[i] = b"".join([*keep, raw[at:]]).decode()
            out = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            yield out.select(columns)

    out = joined.mapInArrow(apply, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
