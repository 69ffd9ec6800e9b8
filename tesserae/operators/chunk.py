"""Chunkers. A chunk is a slice of the whole text: cumulative lengths give the cuts by binary search, then slices are taken."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.written import hidden, pieces

#: A heading's line and the fence of front matter.
HEADING = re.compile(r"^#{1,6}[^\S\n]+\S", re.M)
FENCE = "---"
LINE_END = re.compile("\n")


def paragraph_chunks(text: str, sep: str = "\n\n", limit: int = 1200, overlap: int = 150, least: int = 200) -> Iterator[str]:
    """Slices of the text's paragraphs, joined by blank lines, that end with a paragraph.

    A slice ends before the first paragraph that takes it above `limit`, once it has `least` characters; the next begins
    `overlap` characters before that. A short rest goes; a text of less than `least` characters is one chunk.
    """
    text = text.strip()
    if len(text) < least:
        yield from filter(None, [text])
        return
    paragraphs = [p for p in map(str.strip, text.split(sep)) if p]
    whole = "\n\n".join(paragraphs)
    ends = [e - 2 for e in accumulate(len(p) + 2 for p in paragraphs)]
    start = after = 0  # where the slice begins, and the first paragraph that it may end with
    while (last := max(after, bisect_right(ends, start + limit) - 1, bisect_left(ends, start + least))) < len(ends) - 1:
        yield whole[start : ends[last]].strip()
        start, after = max(start, ends[last] - overlap), last + 1
    if len(rest := whole[start:].strip()) >= least:
        yield rest


def section_chunks(text: str, section: str = "", limit: int = 2000, overlap: int = 200) -> Iterator[tuple[str, str]]:
    """(section, chunk): first the sections between headings, then slices of each that end with a line.

    A slice ends with the first line that takes it above `limit` (a heading's own line never does); the next begins
    `overlap` characters before. What is left of a section goes unless it has more than 100 characters, of the last one
    50. Front matter between two fences goes first.
    """
    if text.startswith(FENCE) and (end := text.find(FENCE, len(FENCE))) > 0:
        text = text[end + len(FENCE) :].strip()
    text += "\n"
    heads = [m.start() for m in HEADING.finditer(text)]
    for number, (first, stop) in enumerate(zip([0, *heads], [*heads, len(text)], strict=True)):
        line_ends = [m.end() for m in LINE_END.finditer(text, first, stop)]
        name, start = section, first
        if number:
            name = text[first : line_ends.pop(0)].lstrip("#").strip()
        at = bisect_right(line_ends, start + limit)
        while at < len(line_ends):
            yield name, text[start : line_ends[at]].strip()
            start = max(start, line_ends[at] - overlap)
            at = max(at + 1, bisect_right(line_ends, start + limit))
        if len(rest := text[start:stop].strip()) > (50 if stop == len(text) else 100):
            yield name, rest


def _chunked(df: DataFrame, keys: list[str], text: Column, section: Column, cut: Callable[[str, str], Iterator[tuple[str, str]]]) -> DataFrame:
    """(keys, chunk_no, section, chunk): rows leave a task in pieces, so it holds the chunks of a bounded part of a batch."""
    n = len(keys)
    rows = df.select(*keys, *(c.alias(name) for c, name in zip((text, section), hidden(keys, "text", "section"), strict=True)))
    names = hidden(keys, "chunk_no", "section", "chunk")
    schema = df.select(*keys, *(F.lit(x).alias(c) for x, c in zip((0, "", ""), names, strict=True))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(batch.column(n)):
                texts, heads = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in (n, n + 1))
                found = [(lo + i, number, *c) for i, (t, name) in enumerate(zip(texts, heads, strict=True)) for number, c in enumerate(cut(t or "", name or ""))]
                row, number, sections, chunks = zip(*found, strict=True) if found else ((), (), (), ())
                at = pa.array(row, pa.int64())
                columns = [*(batch.column(i).take(at) for i in range(n)), pa.array(number, pa.int32()), pa.array(sections, pa.string()), pa.array(chunks, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema).toDF(*keys, "chunk_no", "section", "chunk")


def chunk_paragraphs(df: DataFrame, keys: list[str], text: str = "text", **options) -> DataFrame:
    """(keys, chunk_no, chunk) of every text."""
    cut = lambda t, _: (("", c) for c in paragraph_chunks(t, **options))
    found = _chunked(df, keys, F.col(text), F.lit(""), cut)
    return found.toDF(*keys, "chunk_no", *hidden([*keys, "chunk_no", "chunk"], "section"), "chunk").select(*keys, "chunk_no", "chunk")


def chunk_sections(df: DataFrame, keys: list[str], text: str = "text", section: str | None = None, **options) -> DataFrame:
    """(keys, chunk_no, section, chunk) of every text; section names the column with the name of what precedes headings."""
    cut = lambda t, name: section_chunks(t, name, **options)
    return _chunked(df, keys, F.col(text), F.col(section) if section else F.lit(""), cut)
