"""The first characters of texts in order, by key: kept while the texts are read, so no key's texts are gathered."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that a task holds at once, and tasks that a key's parts go through on their way to one.
HELD_KEYS, FAN_IN = 1_000, 32


class Leading:
    """The texts of one key that lie in its first `limit` characters, in order; texts of one place go by themselves."""

    def __init__(self, limit: int, gap: int):
        self.limit, self.gap, self.length, self.parts = limit, gap, 0, []

    def add(self, place, text: str) -> None:
        insort(self.parts, ((place is not None, place), text))
        self.length += len(text) + self.gap
        while self.parts and self.length - len(self.parts[-1][1]) - self.gap >= self.limit:
            self.length -= len(self.parts.pop()[1]) + self.gap


def _kept(n_keys: int, limit: int, gap: int):
    """Rows (keys, place, text) that can still lie among their key's first characters, of those that a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Leading] = {}
        schema = None

        def out() -> pa.RecordBatch:
            rows = [(*key, place[1], text) for key, lead in held.items() for place, text in lead.parts]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            schema = batch.schema
            for *key, place, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(tuple(key), Leading(limit, gap)).add(place, text)
            if len(held) > HELD_KEYS:
                yield out()
                held = {}
        if held:
            yield out()

    return run


def leading_text(df: DataFrame, keys: list[str], order: str, text: Column, gap: str, limit: int, name: str) -> DataFrame:
    """(keys, name): the first `limit` characters of each key's texts in this order, with `gap` between them.

    Each task keeps only what can lie among a key's first characters; what it keeps is merged by a few tasks for a key,
    then by one, which sees FAN_IN times `limit` characters or so. Null texts are left out, a key of nulls alone too;
    null places come first, texts of one place are in order of themselves; null keys are a key.
    """
    rows = df.select(*keys, order, F.substring(text, 1, limit).alias("text")).where("text is not null")
    schema, keep = rows.schema, _kept(len(keys), limit, len(gap))
    own = rows.mapInArrow(keep, schema)
    some = own.repartition(*keys, F.pmod(F.spark_partition_id(), F.lit(FAN_IN))).mapInArrow(keep, schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, lead, now = [], None, None
        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in range(len(keys))]
            for *key, place, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lead is None or key != now:
                    if lead is not None:
                        parts.append((*now, gap.join(x for _, x in lead.parts)[:limit]))
                    lead, now = Leading(limit, len(gap)), key
                lead.add(place, t)
        if lead is not None:
            parts.append((*now, gap.join(x for _, x in lead.parts)[:limit]))
        if parts:
            columns = list(zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*kinds, pa.string()], strict=True)], [*keys, name])

    out = df.select(*keys, F.lit("").alias(name)).schema
    return some.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(joined, out)
