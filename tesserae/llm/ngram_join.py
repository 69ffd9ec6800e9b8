"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import U64, Words, bloom, chunks, components, cut, discard, mix, texts_of

#: Buckets of the frequency sketch (2 bytes each, whatever the corpus): any total order is exact, this one is rare-first.
SKETCH_BITS = 21
SKETCH_SLICES = 16
#: Intervals of the suffix filter, for all sets and besides for sets of FINE_FROM shingles or more: the distance of two
#: unlike sets over few intervals is a small share of long sets.
PARTS, FINE_PARTS, FINE_FROM = 32, 256, 512
#: Buckets of more classes than this are compared in blocks of about BLOCK_ROWS classes of like lengths and BLOCK_GRAMS
#: shingles, not as joined pairs.
LARGE_BUCKET, BLOCK_ROWS, BLOCK_GRAMS = 64, 2048, 400_000


def _sets(batch: pa.RecordBatch, n: int):
    """(row, distinct n-gram hashes in ascending order) of each text in the batch."""
    words = Words(texts_of(batch))
    grams = words.grams(n)
    for i, (lo, hi) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        if hi - lo >= n:
            yield i, np.unique(grams[lo : hi - n + 1])
        elif hi > lo:
            with np.errstate(over="ignore"):
                h = U64(0)
                for w in words.hash[lo:hi]:
                    h = h * U64(0x9E3779B97F4A7C15) + w
            yield i, mix(np.array([h], U64), 1000 + int(hi - lo))
        else:
            yield i, np.zeros(0, U64)


def _sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Occurrences of n-grams over all documents by hash bucket. Its size is fixed."""
    width, per = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // SKETCH_SLICES

    def count(batches):
        total = np.zeros(width, np.uint32)
        for batch in chunks(batches, "text"):
            at, times = np.unique((Words(texts_of(batch)).grams(n) & U64(width - 1)).astype(np.uint32), return_counts=True)
            total[at] += times.astype(np.uint32)
        parts = total.reshape(SKETCH_SLICES, per)
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_SLICES), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["part", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.uint64)  # exact sums
        if sums:
            small = [np.minimum(s, 65535).astype(np.uint16) for s in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(s.tobytes(), 1) for s in small], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    out = np.zeros(width, np.uint16)
    for row in docs.select("text").mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).collect():  # one row a slice
        out[row["part"] * per : (row["part"] + 1) * per] = np.frombuffer(zlib.decompress(row["counts"]), np.uint16)
    return out


def _signatures(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Per document, as a written table: set size, 128-bit set signature, suffix-filter counts, prefix n-grams rare first."""
    counts = docs.sparkSession.sparkContext.broadcast(_sketch(docs, n))

    def rows(batches):
        freq = counts.value
        for batch in chunks(batches, "text"):
            size, one, two, parts, fine, prefixes = [], [], [], [], [], []
            for _, s in _sets(batch, n):
                k = len(s)
                size.append(k)
                with np.errstate(over="ignore"):
                    one.append(int(mix(s, 1).sum(dtype=U64).astype(np.int64)))
                    two.append(int(mix(s, 2).sum(dtype=U64).astype(np.int64)))
                finest = np.bincount((s >> U64(56)).astype(np.int64), minlength=FINE_PARTS)
                parts.append(finest.reshape(PARTS, -1).sum(1).clip(max=32767).tolist())
                fine.append(finest.clip(max=32767).tolist() if k >= FINE_FROM else None)
                keep = k - (num * k + den - 1) // den + 1 if k else 0
                f = freq[(s & U64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
                prefixes.append(s[np.lexsort((s, f))[:keep]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(parts, pa.list_(pa.int16())), pa.array(fine, pa.list_(pa.int16())), pa.array(prefixes, pa.list_(pa.int64()))],
                ["doc_id", "n", "sig1", "sig2", "parts", "fine", "prefix"],
            )

    out = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n int, sig1 long, sig2 long, parts array<smallint>, fine array<smallint>, prefix array<long>"))
    counts.destroy()
    return out


def _shared_tokens(classes: DataFrame) -> DataFrame:
    """(pos, g, rep, n) of the prefix n-grams that two classes or more have in their prefixes, and a few others.

    Only the bare hashes are counted by a shuffle; the filter over the repeated ones goes to where the prefixes lie.
    """
    repeated = cut(classes.select(F.explode("prefix").alias("g")).groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g"))
    wanted = classes.sparkSession.sparkContext.broadcast(bloom(repeated, repeated.count()))

    def keep(batches):
        for batch in batches:
            prefix = batch.column("prefix")
            row, g = pc.list_parent_indices(prefix), prefix.flatten().to_numpy(zero_copy_only=False)
            row = np.asarray(row, np.int64)
            first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            found = np.flatnonzero(wanted.value.has(g)) if len(g) else np.zeros(0, np.int64)
            of = row[found]
            yield pa.RecordBatch.from_arrays([pa.array((found - first[of]).astype(np.int32)), pa.array(g[found]), batch.column("rep").take(pa.array(of)), batch.column("n").take(pa.array(of))], ["pos", "g", "rep", "n"])

    out = cut(classes.select("prefix", "rep", "n").mapInArrow(keep, "pos int, g long, rep long, n int"))
    wanted.destroy()
    discard(repeated)
    return out


def _fetch(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, grams) of the documents whose doc_id is in ids(id), and of a few others, from one scan."""
    ids = cut(ids.distinct())
    wanted = docs.sparkSession.sparkContext.broadcast(bloom(ids, ids.count()))

    def sets(batches):
        for batch in batches:
            keys = batch.column("doc_id")
            found = wanted.value.has(np.asarray(keys.fill_null(0).to_numpy(zero_copy_only=False), np.int64)) & keys.is_valid().to_numpy(zero_copy_only=False)
            for part in chunks([batch.filter(pa.array(found))], "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.view(np.int64) for _, s in _sets(part, n)], pa.list_(pa.int64()))], ["id", "grams"])

    out = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sets, "id long, grams array<long>"))
    wanted.destroy()
    discard(ids)
    return out


def _linked(pairs: DataFrame, grams: DataFrame, num: int, den: int) -> DataFrame:
    """Of the candidate pairs (a, b), those linked: whole sets of both are compared, once a pair."""
    same = F.size(F.array_intersect("ga", "gb"))
    both = pairs.join(grams.toDF("b", "gb"), "b").join(grams.toDF("a", "ga"), "a")
    return both.where(same * (den + num) >= num * (F.size("ga") + F.size("gb"))).select("a", "b")


def _merged(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """label (the least number of each component) once the components of x[i] and y[i] are one."""
    while (label[x] != label[y]).any():
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        while (label[label] != label).any():
            label = label[label]
    return label


def _block_links(num: int, den: int):
    """For applyInArrow: the links between two blocks of documents, as a spanning forest and never as all pairs.

    left rows are outside the canopy's largest component, the others any. Pairs pass the component, length and suffix
    filters first; only documents of a pair that passes are compared, by products of their sets' incidence.
    """

    def run(rows: pa.Table) -> pa.Table:
        rep, component = (rows.column(c).to_numpy().astype(np.int64) for c in ("rep", "component"))
        left = np.flatnonzero(rows.column("left").to_numpy(zero_copy_only=False))
        right = np.flatnonzero(~rows.column("left").to_numpy(zero_copy_only=False))
        major = rows.column("major").to_numpy(zero_copy_only=False)
        lists = rows.column("grams").combine_chunks()
        gram, row = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(pc.list_parent_indices(lists), np.int64)
        size = np.bincount(row, minlength=len(rep))
        first = np.concatenate([[0], np.cumsum(size)])
        fine = np.bincount(row * FINE_PARTS + (gram.view(U64) >> U64(56)).astype(np.int64), minlength=len(rep) * FINE_PARTS).reshape(-1, FINE_PARTS)
        coarse = fine.reshape(len(rep), PARTS, -1).sum(2)
        ids, at = np.unique(rep, return_inverse=True)
        label = np.arange(len(ids))

        def passes(x: np.ndarray, y: np.ndarray, bins: np.ndarray, ok: np.ndarray) -> np.ndarray:
            total = size[x, None] + size[y]
            apart = np.zeros(ok.shape, np.int32)
            for k in range(bins.shape[1]):
                apart += np.abs(bins[x, k : k + 1] - bins[y, k]).astype(np.int32)
            return ok & ((total - apart) * (den + num) >= total * (2 * num))

        def overlap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            mine = np.concatenate([gram[first[i] : first[i + 1]] for i in x])
            other = np.concatenate([gram[first[i] : first[i + 1]] for i in y])
            both = np.intersect1d(mine, other)
            same = np.zeros((len(x), len(y)), np.float32)
            of_x, of_y = np.repeat(np.arange(len(x)), size[x]), np.repeat(np.arange(len(y)), size[y])
            place = [np.searchsorted(both, g) for g in (mine, other)]
            known = [(p < len(both)) & (both[np.minimum(p, len(both) - 1)] == g) if len(both) else np.zeros(len(g), bool) for p, g in zip(place, (mine, other), strict=True)]
            for lo in range(0, len(both), 4096):
                sides = []
                for p, k, of, n in zip(place, known, (of_x, of_y), (len(x), len(y)), strict=True):
                    here = k & (p >= lo) & (p < lo + 4096)
                    has = np.zeros((n, min(4096, len(both) - lo)), np.float32)
                    has[of[here], p[here] - lo] = 1
                    sides.append(has)
                same += sides[0] @ sides[1].T
            return same.astype(np.int64)

        for lo in range(0, len(left), 256):
            x, y = left[lo : lo + 256], right
            ok = (component[x, None] != component[y]) & (major[y] | (rep[x, None] < rep[y]))
            ok &= np.minimum(size[x, None], size[y]) * den >= np.maximum(size[x, None], size[y]) * num
            for bins in (coarse, fine):
                i, j = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
                x, y, ok = x[i], y[j], ok[np.ix_(i, j)]
                ok = passes(x, y, bins, ok)
            i, j = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
            if len(i):
                x, y = x[i], y[j]
                near = ok[np.ix_(i, j)] & (overlap(x, y) * (den + num) >= num * (size[x, None] + size[y]))
                a, b = np.nonzero(near)
                label = _merged(label, at[x[a]], at[y[b]])
        joined = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": ids[label[joined]], "b": ids[joined]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def _dense_links(members: DataFrame, grams: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """(a, b): links between components of members(g, rep, n, component, major) of canopies g; grams(rep, grams).

    Sets can only link where their sizes are within den / num of each other, so a document meets its own band of lengths
    and the two beside it. Each band is dealt by hash into blocks of about `block` documents and BLOCK_GRAMS shingles;
    only block pairs meet, and a task holds two blocks, whatever the canopy's size.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(den / num)) if den > num else 1.0) + F.lit(1e-9)).cast("int")
    minor = F.col("component") != F.col("major")
    rows = members.withColumn("band", band)
    count = lambda kind: F.ceil(F.greatest(F.sum(kind.cast("long")) / block, F.sum(F.when(kind, F.col("n")).otherwise(0)) / BLOCK_GRAMS)).cast("int")
    sizes = rows.groupBy("g", "band").agg(count(F.lit(True)).alias("blocks"), count(minor).alias("minors"))
    near = sizes.select("g", F.explode(F.array(*(F.struct((F.col("band") + d).alias("band"), F.lit(d).alias("d"), "blocks", "minors") for d in (-1, 0, 1)))).alias("z"))
    near = near.groupBy("g", F.col("z.band").alias("band")).agg(F.array_sort(F.collect_list("z")).alias("near"))  # three at most
    rows = rows.join(sizes, ["g", "band"]).join(near, ["g", "band"]).withColumn("own", F.xxhash64("rep"))
    other = lambda z, count: F.when(z[count] > 0, F.transform(F.sequence(F.lit(0), F.greatest(z[count] - 1, F.lit(0))), lambda k: F.struct((F.col("band") - z["d"]).alias("band"), k.alias("k")))).otherwise(F.expr("cast(array() as array<struct<band:int,k:int>>)"))
    all_of = lambda count: F.flatten(F.transform("near", lambda z: other(z, count)))
    keep = ["g", "rep", "component", (~minor).alias("major")]
    left = rows.where(minor).select(*keep, F.lit(True).alias("left"), F.col("band").alias("b1"), F.pmod("own", F.greatest("minors", F.lit(1))).cast("int").alias("i"), F.explode(all_of("blocks")).alias("o")).select("*", F.col("o.band").alias("b2"), F.col("o.k").alias("j")).drop("o")
    right = rows.select(*keep, F.lit(False).alias("left"), F.col("band").alias("b2"), F.pmod("own", "blocks").cast("int").alias("j"), F.explode(all_of("minors")).alias("o")).select("*", F.col("o.band").alias("b1"), F.col("o.k").alias("i")).drop("o")
    tasks = left.unionByName(right).join(grams, "rep")
    return tasks.groupBy("g", "b1", "i", "b2", "j").applyInArrow(_block_links(num, den), "a long, b long")


def ngram_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, large: int = LARGE_BUCKET, block: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text); component_id is the smallest id reachable.

    Two documents link when den * |A & B| >= num * |A | B| for their sets of distinct n-word shingles (ASCII-lower-cased
    words between ASCII white space; a shorter text is one shingle). Null and empty texts have no shingle and link
    with nothing; rows without doc_id link with nothing and have a null component_id. Repeated rows each get their row.

    Documents with equal sets are one class. Classes are joined on their prefix n-grams, rarest first. A first pass
    pairs each member of a token's bucket with one leader only, the one with the fewest rarer shingles (in a group of
    edited copies the least edited); pairs within what that has already connected are never made. The rest of a bucket
    is compared in full under the length, positional and suffix filters, so no link between components is lost: as
    joined pairs where a bucket has at most `large` classes, which are verified once a pair. Larger buckets that share
    classes are one canopy; its classes are compared in blocks of `block` classes of like lengths, under the length and
    suffix filters, and each block pair gives only the links that connect something. large and block change the plan, not
    the result. Classes of one canopy that stay unlinked cost compares in the square of their number and rows by their
    number of blocks. Sets are compared by 64-bit hashes of their shingles.
    """
    rows = _signatures(docs, n, num, den)
    live = rows.where("n > 0 and doc_id is not null")
    classes = live.groupBy("n", "sig1", "sig2").agg(F.min("doc_id").alias("rep"), F.first("parts").alias("parts"), F.first("fine").alias("fine"), F.first("prefix").alias("prefix"))
    classes = cut(classes)
    slim = cut(rows.select("doc_id", "n", "sig1", "sig2"))
    discard(rows)
    rows = slim
    tokens = _shared_tokens(classes)
    seed = F.xxhash64("rep")
    buckets = tokens.groupBy("g").agg(F.count("*").alias("c"), F.min(F.struct("pos", seed.alias("r"), "rep", "n")).alias("top")).where("c > 1").select("g", "top")
    shared = cut(tokens.join(buckets, "g").select("g", "rep", "n", "pos", F.col("top.rep").alias("l_rep"), F.col("top.n").alias("l_n"), F.col("top.pos").alias("l_pos")))

    def fits(n1, p1, n2, p2):
        """Length and positional filter: with these prefix positions the overlap can still be large enough."""
        most = F.least(F.col(n1) - F.col(p1), F.col(n2) - F.col(p2)) + F.least(p1, p2)
        need = (F.col(n1).cast("long") + F.col(n2)) * num
        return (F.least(n1, n2).cast("long") * den >= F.greatest(n1, n2).cast("long") * num) & (most.cast("long") * (den + num) >= need)

    parts = classes.select("rep", "n", "parts", "fine")

    def suffix_filter(pairs):
        """Counts by hash interval bound the distance of two sets from below."""
        both = pairs.join(parts.toDF("a", "na", "pa", "fa"), "a").join(parts.toDF("b", "nb", "pb", "fb"), "b")

        def distance(x, y):
            return F.aggregate(F.zip_with(x, y, lambda s, t: F.abs(s.cast("int") - t)), F.lit(0), lambda total, d: total + d)

        apart = F.when(F.col("fa").isNotNull() & F.col("fb").isNotNull(), distance("fa", "fb")).otherwise(distance("pa", "pb"))
        total = F.col("na").cast("long") + F.col("nb")
        return both.where((total - apart) * (den + num) >= total * (2 * num)).select("a", "b")

    pairs = shared.where("rep <> l_rep").where(fits("n", "pos", "l_n", "l_pos")).select(F.col("l_rep").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = cut(suffix_filter(pairs))
    grams = _fetch(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), n)
    links = cut(_linked(pairs, grams, num, den))
    checked = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    discard(pairs, grams)
    label = cut(components(links.toDF("u", "v")))

    marked = shared.select("g", "rep", "n", "pos").join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    by = marked.groupBy("g", "component").agg(F.count("*").alias("k"))
    mixed = by.groupBy("g").agg(F.count("*").alias("c"), F.max_by("component", "k").alias("major"), F.sum("k").alias("all")).where("c > 1")
    marked = cut(marked.join(mixed.select("g", "major", "all"), "g"))

    few = marked.where(F.col("all") <= large)
    minor = few.where("component <> major").select("g", F.col("rep").alias("a"), F.col("n").alias("n1"), F.col("pos").alias("p1"), F.col("component").alias("c1"))
    every = few.select("g", F.col("rep").alias("b"), F.col("n").alias("n2"), F.col("pos").alias("p2"), F.col("component").alias("c2"), (F.col("component") == F.col("major")).alias("major"))
    rest = minor.join(every, "g").where((F.col("c1") != F.col("c2")) & (F.col("major") | (F.col("a") < F.col("b")))).where(fits("n1", "p1", "n2", "p2"))
    rest = suffix_filter(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(checked, ["a", "b"], "left_anti"))
    pairs = cut(rest)
    many = marked.where(F.col("all") > large).select("g", "rep", "n", "component")
    canopy = components(many.join(many.groupBy("g").agg(F.min("rep").alias("v")), "g").select(F.col("rep").alias("u"), "v"))
    members = cut(canopy.toDF("rep", "g").join(many.select("rep", "n", "component").distinct(), "rep"))
    major = members.groupBy("g", "component").agg(F.count("*").alias("k")).groupBy("g").agg(F.max_by("component", F.struct("k", "component")).alias("major"))
    grams = _fetch(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).union(members.select("rep")), n)
    near = _linked(pairs, grams, num, den)
    dense = _dense_links(members.join(major, "g"), grams.toDF("rep", "grams"), num, den, block)
    final = cut(components(links.union(near).union(dense).toDF("u", "v")))

    named = cut(classes.select("n", "sig1", "sig2", "rep").join(final.withColumnRenamed("id", "rep"), "rep", "left").select("n", "sig1", "sig2", F.coalesce("component", "rep").alias("component")))
    discard(classes, tokens, shared, links, checked, label, marked, pairs, members, grams, final)
    out = rows.select("doc_id", "n", "sig1", "sig2").join(named, ["n", "sig1", "sig2"], "left")
    own = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))
