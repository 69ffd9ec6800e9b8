"""Data sources of our own: event-stream files by ranges of bytes and pages by file, in batches and as streams that resume.

    spark.dataSource.register(EventFiles)
    spark.read.format("event_files").load("folder")
    spark.readStream.format("event_files").load("folder")

Lines and pages are parsed where they are read. A stream's offset is how far each file has been read, up to the end of
its last whole line, so files may grow and appear; it holds a number for each file.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tesserae.sources.files import page_text

#: Bytes of one partition of an event file, and of a page at most one file.
SPLIT = 32 << 20
#: The fields of an event, with their kinds.
EVENT = {"type": str, "text": str, "name": str, "detail": str, "ms": float, "reason": str, "note": str}


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def _files(root: str) -> tuple[fs.FileSystem, dict[str, int]]:
    """The file system of a path and the sizes of the files below it, hidden ones left out."""
    system, path = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return system, {f.path: f.size for f in found if f.is_file and not f.base_name.startswith(("_", "."))}


def parse_event(line: bytes) -> tuple | None:
    """An event of a `data: ` line in the order of EVENT; the end mark is of type done; None for what is none."""
    if not line.startswith(b"data: "):
        return None
    data = line[6:].rstrip(b"\r\n").decode("utf-8", "replace")
    if data == "[DONE]":
        return ("done", *[None] * (len(EVENT) - 1))
    try:
        event = json.loads(data)
    except ValueError:
        return None
    if not isinstance(event, dict) or event.get("type") is None:
        return None

    def field(value, kind):
        if value is None or (kind is float and (isinstance(value, bool) or not isinstance(value, int | float))):
            return None
        return kind(value) if kind is float or isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)

    return tuple(field(event.get(name), kind) for name, kind in EVENT.items())


def _lines(system: fs.FileSystem, part: Range) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in a range of bytes."""
    with system.open_input_file(part.path) as raw:
        at = max(0, part.start - 1)
        raw.seek(at)
        f = io.BufferedReader(raw, 1 << 20)
        if part.start:
            at += len(f.readline())  # the line that begins before, or the end of it
        while at < part.end and (line := f.readline()):
            yield at, line
            at += len(line)


class _Reading:
    """What batch and stream readers of one kind share."""

    def __init__(self, options: dict):
        self.root, self.split = options["path"], int(options.get("split", SPLIT))

    def system(self) -> fs.FileSystem:
        return fs.FileSystem.from_uri(self.root)[0] if "://" in self.root else fs.LocalFileSystem()

    def ranges(self, begin: dict[str, int], end: dict[str, int]) -> list[Range]:
        out = []
        for path, stop in sorted(end.items()):
            start = begin.get(path, 0)
            out += [Range(path, lo, min(lo + self.split, stop)) for lo in range(start, stop, self.split)]
        return out or [Range("", 0, 0)]


class _Events(_Reading):
    def reach(self) -> dict[str, int]:
        """How far each file has whole lines."""
        system, sizes = _files(self.root)
        out = {}
        for path, size in sizes.items():
            with system.open_input_file(path) as f:
                end = size
                while end > 0:
                    lo = max(0, end - (1 << 16))
                    f.seek(lo)
                    at = f.read(end - lo).rfind(b"\n")
                    if at >= 0:
                        out[path] = lo + at + 1
                        break
                    end = lo
        return out

    def rows(self, part: Range) -> Iterator[tuple]:
        if part.path:
            for offset, line in _lines(self.system(), part):
                event = parse_event(line)
                if event:
                    yield (part.path, offset, *event)


class _Pages(_Reading):
    def reach(self) -> dict[str, int]:
        return {path: 1 for path in _files(self.root)[1]}

    def rows(self, part: Range) -> Iterator[tuple]:
        if part.path:
            with self.system().open_input_file(part.path) as f:
                text = page_text(f.read().decode("utf-8", "replace"))
            yield part.path, text, len(text)


class _Batch(DataSourceReader):
    def __init__(self, reading: _Reading, whole: bool):
        self.reading, self.whole = reading, whole

    def partitions(self) -> list[Range]:
        end = _files(self.reading.root)[1] if self.whole else self.reading.reach()
        return self.reading.ranges({}, end)

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.reading.rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, reading: _Reading):
        self.reading = reading

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return self.reading.reach()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.reading.ranges(start, end)

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.reading.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class EventFiles(DataSource):
    """(path, offset, an event's fields) of the `data: ` lines of files; a last line without an end is read in batches only."""

    @classmethod
    def name(cls) -> str:
        return "event_files"

    def schema(self) -> str:
        kinds = {str: "string", float: "double"}
        return "path string, offset long, " + ", ".join(f"{n} {kinds[k]}" for n, k in EVENT.items())

    def reader(self, schema) -> DataSourceReader:
        return _Batch(_Events(self.options), True)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(_Events(self.options))


class PageFiles(DataSource):
    """(path, text, n_chars) of HTML files."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return "path string, text string, n_chars long"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(_Pages(self.options), False)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(_Pages(self.options))
