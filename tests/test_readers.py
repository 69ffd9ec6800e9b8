"""Our data sources: batch and stream reads of the same files agree, in small ranges and after restarts."""

import json

import pytest
from pyspark.sql import functions as F

from tesserae.sources import files
from tesserae.sources.readers import EventFiles, PageFiles

LINES = [
    'data: {"type":"token","text":"a"}', "event: x", "", "data: {bad", 'data: {"type":"token","text":"é\\u00fc \\n"}', "data: [DONE]", 'data: {"text":"no type"}', "data: [1]", 'data: {"type":"step_done","name":"Triage","detail":"d","ms":1.5}',
    'data: {"type":"model","name":"m","ms":3,"more":{"x":1}}', 'data:{"type":"token"}', 'data: {"type":"token","text":7}', "data: ",
]


@pytest.fixture(scope="module")
def sources(spark):
    spark.dataSource.register(EventFiles)
    spark.dataSource.register(PageFiles)
    return spark


def write(path, lines, mode="w", end="\n"):
    path.parent.mkdir(exist_ok=True)
    with open(path, mode, encoding="utf-8", newline="") as f:
        f.write("".join(x + end for x in lines))


def events(df):
    return sorted(repr(tuple(r)) for r in df.select("type", "text", "name", "detail", "ms", "reason", "note").collect())


@pytest.mark.parametrize("split", [37, 300, 1 << 20])
def test_events_are_those_of_the_text_reader(sources, tmp_path, split):
    write(tmp_path / "in" / "a.txt", LINES * 3)
    write(tmp_path / "in" / "b.txt", LINES, end="\r\n")
    write(tmp_path / "in" / "_hidden", LINES)
    write(tmp_path / "in" / "empty.txt", [])
    with open(tmp_path / "in" / "c.txt", "w") as f:
        f.write('data: {"type":"token","text":"no end"}')
    found = sources.read.format("event_files").option("split", split).load(f"{tmp_path}/in")
    lines = sources.read.text([f"{tmp_path}/in/{n}.txt" for n in "abc"])
    assert events(found) == events(files.read_sse(lines))
    assert found.count() == found.select("path", "offset").distinct().count() and found.count() == 4 * 6 + 1


def test_streams_resume(sources, tmp_path):
    """Files that grow, appear and end in half a line; each start goes on where the last one stopped."""

    def run():
        rows = sources.readStream.format("event_files").option("split", 50).load(f"{tmp_path}/in")
        query = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return sources.read.parquet(f"{tmp_path}/out")

    write(tmp_path / "in" / "a.txt", LINES)
    assert run().count() == 6
    write(tmp_path / "in" / "a.txt", LINES[:2], "a")
    write(tmp_path / "in" / "b.txt", LINES)
    with open(tmp_path / "in" / "b.txt", "a") as f:
        f.write('data: {"type":"tok')
    assert run().count() == 13
    with open(tmp_path / "in" / "b.txt", "a") as f:
        f.write('en","text":"late"}\n')
    out = run()
    assert events(out) == events(sources.read.format("event_files").load(f"{tmp_path}/in")) and run().count() == 14
    assert json.loads('"late"') in {r["text"] for r in out.collect()}


def test_pages(sources, tmp_path):
    pages = {"a.html": "<html><body><nav>x</nav><main>Main é</main></body></html>", "b.html": "<p>plain</p>", "c.html": ""}
    (tmp_path / "in").mkdir()
    for name, html in pages.items():
        (tmp_path / "in" / name).write_text(html)
    batch = sources.read.format("page_files").load(f"{tmp_path}/in")
    want = {name: files.page_text(html) for name, html in pages.items()}
    assert {r["path"].rsplit("/", 1)[1]: r["text"] for r in batch.collect()} == want
    for _ in range(2):
        rows = sources.readStream.format("page_files").load(f"{tmp_path}/in")
        rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    out = sources.read.parquet(f"{tmp_path}/out")
    assert out.count() == 3 and out.agg(F.sum("n_chars")).first()[0] == sum(map(len, want.values()))
