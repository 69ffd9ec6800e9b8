"""Python tasks turn a bounded part of a batch into objects at once, with the same rows."""

import pyarrow as pa

from tesserae.operators import chunk, generate, written


def test_pieces_cover_all_rows():
    texts = pa.array(["a" * 10, None, "é" * (1 << 20), "", "b"] * 700)
    found = list(written.pieces(texts))
    assert [lo for lo, _ in found] == [0, *(hi for _, hi in found[:-1])] and found[-1][1] == len(texts)
    assert max(hi - lo for lo, hi in found) <= written.PIECE_ROWS
    assert all(sum(len((t or "").encode()) for t in texts[lo : hi - 1].to_pylist()) <= written.PIECE_BYTES + (2 << 20) for lo, hi in found)
    assert not list(written.pieces(pa.array([], pa.string())))


def test_backends_and_chunkers_see_pieces(spark, monkeypatch):
    class Counting:
        def generate(self, prompts):
            return [f"{len(prompts)}|{p}" for p in prompts]

    rows = [(i, None if i == 3 else f"line {i}\n## head {i}\n" + "x y " * (i % 90)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["reply"] for r in generate.map_backend(df, Counting().generate, "text", "reply").collect()}
    assert all(int(got[i].split("|", 1)[0]) <= written.PIECE_ROWS and got[i].split("|", 1)[1] == str(t) for i, t in rows)
    chunks = {(r["section"], r["chunk_no"]): r["chunk"] for r in chunk.chunk_sections(df.withColumnRenamed("doc_id", "section"), ["section"]).toDF("section", "chunk_no", "name", "chunk").collect()}
    want = {(i, n): c for i, t in rows for n, (_, c) in enumerate(chunk.section_chunks(t or ""))}
    assert chunks == want
