"""Chat formatting over prefix trees: shared first turns' tokens once, depth-first, with position ids and ancestor intervals."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, discard
from tesserae.llm.packing import Encoder

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>\n"
#: Turns and characters after which a conversation goes on in another segment, and characters of a sequence.
SEGMENT_TURNS, SEGMENT_CHARS, SEQUENCE_CHARS = 256, 1 << 20, 1 << 17
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    """A text without the template's control strings: a backslash goes before each backslash and into each `<|`."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(n|.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def _escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text begins and ends there."""
    head = f"{START}{_escape_role(role)}\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(turn: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    if not (turn.startswith(START) and turn.endswith(END)):
        raise ValueError("not a turn")
    role, _, body = turn[len(START) : -len(END)].partition("\n")
    return unescape(role), unescape(body)


@functools.lru_cache(maxsize=2)
def _kept(arguments: tuple) -> Encoder:
    return Encoder(**dict(arguments))


def encoder_of(arguments: dict) -> Encoder:
    """The Encoder of these arguments; a worker keeps it, and what it remembers, from task to task."""
    return _kept(tuple(sorted(arguments.items())))


class Template:
    """The units of formatted turns: ids of a tokenizer where an encoder is given (arguments of Encoder), else characters.

    A turn's mark, its escaped text and its end are encoded each by itself, so that turns and the loss mask begin and end
    between ids, and a turn has the same ids wherever it stands.
    """

    def __init__(self, encoder: dict | None):
        self.encoder = encoder
        self.marks: dict[str, array] = {}

    def ids(self, text: str) -> array:
        return array("I", encoder_of(self.encoder).encode(text)) if text else array("I")

    def mark(self, text: str) -> array:
        if text not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[text] = self.ids(text)
        return self.marks[text]

    def turn(self, role: str, text: str):
        """A formatted turn, its number of units, and where its text begins and ends there."""
        whole, lo, hi = render(role, text)
        if self.encoder is None:
            return whole, len(whole), lo, hi
        head, body, end = self.mark(whole[:lo]), self.ids(whole[lo:hi]), self.mark(END)
        return head + body + end, len(head) + len(body) + len(end), len(head), len(head) + len(body)


@functools.lru_cache(maxsize=2)
def _bytes_of(ranks_path: str) -> dict[int, bytes]:
    with open(ranks_path, "rb") as f:
        return {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}


class Reader:
    """Text of what a Template wrote."""

    def __init__(self, encoder: dict | None):
        self.table = _bytes_of(encoder["ranks_path"]) if encoder else None

    def text(self, units) -> str:
        return units if self.table is None else b"".join(map(self.table.__getitem__, units)).decode()


SEGMENTS = "conv_id long, seg int, last boolean, root string, base long, path string, roles array<string>, texts array<string>"
SEQUENCES = """sequence long, text string, ids array<int>,
    nodes array<struct<parent:int, start:int, end:int, position:long, loss_start:int, loss_end:int>>,
    ancestors array<array<struct<start:int, end:int>>>,
    leaves array<struct<conv_id:long, seg:int, last:boolean, node:int>>"""


def _segments(batches, encoder: dict | None, most_turns: int, most_chars: int):
    """Rows sorted by conversation and turn, to a row for each segment. A segment's bounds depend on its turns alone."""
    out: list[tuple] = []
    state = None
    template = Template(encoder)

    def close(last: bool):
        conv, seg, root, base, path, roles, texts, _ = state
        out.append((conv, seg, last, root, base, "".join(path), roles, texts))

    def batch_of():
        cols = list(zip(*out, strict=True))
        out.clear()
        types = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "seg", "last", "root", "base", "path", "roles", "texts"])

    held = 0
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            role, text = role or "", text or ""
            if state is None or state[0] != conv:
                if state is not None:
                    close(True)
                state = (conv, 0, "", 0, [], [], [], "")
            elif len(state[5]) >= most_turns or sum(map(len, state[6][-1:])) + held > most_chars:
                close(False)
                base = state[3] + sum(template.turn(r, t)[1] for r, t in zip(state[5], state[6], strict=True))
                state = (conv, state[1] + 1, state[7], base, [], [], [], state[7])
            held = sum(map(len, state[6])) if not state[5] else held + len(state[6][-1])
            node = hashlib.blake2b(f"{state[7]}\0{len(role)}\0{role}{text}".encode(), digest_size=12).hexdigest()
            state[4].append(node)
            state[5].append(role)
            state[6].append(text)
            state = (*state[:7], node)
            if len(out) >= 200:
                yield batch_of()
    if state is not None:
        close(True)
    if out:
        yield batch_of()


class _Sequence:
    """A forest of turns in depth-first order while its conversations come sorted by path."""

    def __init__(self, number: int, template: Template):
        self.number, self.template, self.parts, self.size, self.chars = number, template, [], 0, 0
        self.nodes: list[dict] = []
        self.ancestors: list[list[dict]] = []
        self.leaves: list[dict] = []
        self.stack: list[tuple[str, int]] = []  # (node hash, index)
        self.root = None

    def shared(self, root: str, path: list[str]) -> int:
        n = 0
        if root == self.root:
            while n < min(len(path), len(self.stack)) and self.stack[n][0] == path[n]:
                n += 1
        return n

    def add(self, conv, seg, last, root, base, path, roles, texts) -> None:
        n = self.shared(root, path)
        del self.stack[n:]
        self.root = root
        for node, role, text in zip(path[n:], roles[n:], texts[n:], strict=True):
            turn, units, lo, hi = self.template.turn(role, text)
            parent = self.stack[-1][1] if self.stack else -1
            intervals = []
            if parent >= 0:
                up = self.nodes[parent]
                intervals = [dict(x) for x in self.ancestors[parent]]
                if intervals and intervals[-1]["end"] == up["start"]:
                    intervals[-1]["end"] = up["end"]
                else:
                    intervals.append({"start": up["start"], "end": up["end"]})
                position = up["position"] + up["end"] - up["start"]
            else:
                position = base
            loss = role == LOSS_ROLE
            self.nodes.append({"parent": parent, "start": self.size, "end": self.size + units, "position": position, "loss_start": self.size + lo if loss else -1, "loss_end": self.size + hi if loss else -1})
            self.ancestors.append(intervals)
            self.parts.append(turn)
            self.size += units
            self.chars += len(role) + len(text) + len(START) + len(END) + 1
            self.stack.append((node, len(self.nodes) - 1))
        self.leaves.append({"conv_id": conv, "seg": seg, "last": last, "node": self.stack[-1][1]})

    def batch(self) -> pa.RecordBatch:
        ids = None
        if self.template.encoder is not None:
            ids = np.concatenate([np.frombuffer(p, np.uint32) for p in self.parts]).astype(np.int32)
        return pa.RecordBatch.from_pylist([{"sequence": self.number, "text": "".join(self.parts) if ids is None else None, "ids": ids, "nodes": self.nodes, "ancestors": self.ancestors, "leaves": self.leaves}], schema=_ARROW)


_INTERVAL = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_ARROW = pa.schema(
    [
        ("sequence", pa.int64()),
        ("text", pa.string()),
        ("ids", pa.list_(pa.int32())),
        ("nodes", pa.list_(pa.struct([("parent", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("position", pa.int64()), ("loss_start", pa.int32()), ("loss_end", pa.int32())]))),
        ("ancestors", pa.list_(pa.list_(_INTERVAL))),
        ("leaves", pa.list_(pa.struct([("conv_id", pa.int64()), ("seg", pa.int32()), ("last", pa.bool_()), ("node", pa.int32())]))),
    ]
)


def _sequences(batches, encoder: dict | None, most_chars: int):
    number, template = TaskContext.get().partitionId() << 40, Template(encoder)
    now = _Sequence(number, template)
    for batch in batches:
        for row in batch.to_pylist():
            path = [row["path"][i : i + 24] for i in range(0, len(row["path"]), 24)]
            n = now.shared(row["root"], path)
            new = sum(len(r) + len(t) + len(START) + len(END) + 1 for r, t in zip(row["roles"][n:], row["texts"][n:], strict=True))
            if now.leaves and (now.chars + new > most_chars or len(now.leaves) >= 4096):
                yield now.batch()
                number += 1
                now = _Sequence(number, template)
            now.add(row["conv_id"], row["seg"], row["last"], row["root"], row["base"], path, row["roles"], row["texts"])
    if now.leaves:
        yield now.batch()


LEAVES = "conv_id long, seg int, sequence long, top int, intervals array<struct<start:int, end:int>>"
BEFORE = "sequence long, top int, before array<struct<sequence:long, start:int, end:int>>"


def _leaves(batches):
    """Of conversations of several segments: where each segment lies and the tree's first turn that it starts with."""
    schema = pa.schema([("conv_id", pa.int64()), ("seg", pa.int32()), ("sequence", pa.int64()), ("top", pa.int32()), ("intervals", pa.list_(_INTERVAL))])
    for batch in batches:
        for row in batch.to_pylist():
            nodes, out = row["nodes"], []
            for leaf in row["leaves"]:
                if leaf["seg"] == 0 and leaf["last"]:
                    continue
                top, own = leaf["node"], nodes[leaf["node"]]
                while nodes[top]["parent"] >= 0:
                    top = nodes[top]["parent"]
                intervals = [*row["ancestors"][leaf["node"]], {"start": own["start"], "end": own["end"]}]
                out.append({"conv_id": leaf["conv_id"], "seg": leaf["seg"], "sequence": row["sequence"], "top": top, "intervals": intervals})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)


def _before(batches):
    """Segments sorted by conversation and number, to the intervals of all segments before each."""
    schema = pa.schema([("sequence", pa.int64()), ("top", pa.int32()), ("before", pa.list_(pa.struct([("sequence", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])))])
    above: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["seg"] == 0:
                above = []
            else:
                yield pa.RecordBatch.from_pylist([{"sequence": row["sequence"], "top": row["top"], "before": above}], schema=schema)
            above = above + [{"sequence": row["sequence"], **x} for x in row["intervals"]]


def format_conversations(turns: DataFrame, encoder: dict | None = None, segment_turns: int = SEGMENT_TURNS, segment_chars: int = SEGMENT_CHARS, sequence_chars: int = SEQUENCE_CHARS) -> DataFrame:
    """Sequences of turns of conversations(conv_id, turn, role, text), each a forest of shared prefixes in DFS order.

    ids is the formatted sequence in ids of the encoder's tokenizer, which the spans count; without an encoder text is,
    and they count characters. Each node is a turn: its span, its parent, the position id of its first unit (the length
    of what stands above it) and the span under the loss mask (an assistant's escaped text, else -1). A node's units
    attend to the intervals in ancestors and to themselves. leaves say where conversations end. Segments bound what a
    task holds, not the attention: before has, for each first turn (top) of a later segment, the intervals of sequences
    that hold all turns of the segments before; top and all below it attend to these as well.

    Null texts and roles are empty. Rows with equal turns follow each other by role and text, and repeated rows stay;
    null turns come first. Rows without conv_id are one conversation. Other columns are left out, and an empty table gives
    an empty one. Long conversations go on in further segments (after segment_turns turns or segment_chars characters),
    which are shared like first turns are. Conversations are sorted by their paths over range partitions, so a first turn
    that all share is split over tasks and sequences; it is repeated once in each sequence of at most sequence_chars
    characters.
    """
    rows = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    segments = cut(rows.select("conv_id", "role", "text").mapInArrow(lambda b: _segments(b, encoder, segment_turns, segment_chars), SEGMENTS))
    order = ["root", "path", "conv_id", "seg"]
    sequences = segments.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda b: _sequences(b, encoder, sequence_chars), SEQUENCES)
    if not segments.where("seg > 0").limit(1).count():
        return sequences.withColumn("before", F.expr("cast(array() as array<struct<top:int, before:array<struct<sequence:long, start:int, end:int>>>>)"))
    sequences = cut(sequences)
    discard(segments)
    before = sequences.select("sequence", "nodes", "ancestors", "leaves").mapInArrow(_leaves, LEAVES).repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_before, BEFORE)
    before = before.groupBy("sequence", "top").agg(F.min("before").alias("before"))  # of equal paths any will do
    before = before.groupBy("sequence").agg(F.array_sort(F.collect_list(F.struct("top", "before"))).alias("before"))
    return sequences.join(before, "sequence", "left").withColumn("before", F.coalesce("before", F.array().cast(before.schema["before"].dataType)))


PARTS = "conv_id long, seg int, last boolean, n_turns long, turns string, loss string, formatted_chars long, turns_sha256 string, loss_chars long, loss_sha256 string"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _read(batches, encoder: dict | None):
    reader = Reader(encoder)
    for batch in batches:
        for row in batch.to_pylist():
            units, nodes, out = row["text"] if encoder is None else row["ids"], row["nodes"], []
            texts: dict[int, tuple[str, str, str, int]] = {}  # by node: role and text, parsed once however many share them
            for leaf in row["leaves"]:
                path, at = [], leaf["node"]
                while at >= 0:
                    path.append(nodes[at])
                    at = nodes[at]["parent"]
                path.reverse()
                for x in path:
                    if x["start"] not in texts:
                        lo, hi = (x["loss_start"], x["loss_end"]) if x["loss_start"] >= 0 else (x["end"], x["end"])
                        head, masked, end = (reader.text(units[a:b]) for a, b in ((x["start"], lo), (lo, hi), (hi, x["end"])))
                        turn = head + masked + end
                        texts[x["start"]] = (*parse(turn), unescape(masked), len(turn))
                turns = [texts[x["start"]] for x in path]
                canon = "".join(f"{role}\n{body}\n" for role, body, _, _ in turns)
                loss = "".join(masked for _, _, masked, _ in turns)
                whole = leaf["seg"] == 0 and leaf["last"]
                out.append(
                    {"conv_id": leaf["conv_id"], "seg": leaf["seg"], "last": leaf["last"], "n_turns": len(turns), "turns": None if whole else canon, "loss": None if whole else loss, "formatted_chars": sum(n for _, _, _, n in turns)}
                    | ({"turns_sha256": _digest(canon), "loss_chars": len(loss), "loss_sha256": _digest(loss)} if whole else {"turns_sha256": None, "loss_chars": None, "loss_sha256": None})
                )
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("seg", pa.int32()), ("last", pa.bool_()), ("n_turns", pa.int64()), ("turns", pa.string()), ("loss", pa.string()), ("formatted_chars", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string())]))


def _joined(batches):
    """Segments sorted by conversation and number, hashed as they pass."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    turns = loss = None
    n = chars = formatted = 0
    for batch in batches:
        for row in batch.to_pylist():
            if turns is None:
                turns, loss, n, chars, formatted = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            turns.update(row["turns"].encode())
            loss.update(row["loss"].encode())
            n, chars, formatted = n + row["n_turns"], chars + len(row["loss"]), formatted + row["formatted_chars"]
            if row["last"]:
                yield pa.RecordBatch.from_pylist([{"conv_id": row["conv_id"], "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted}], schema=schema)
                turns = None


def read_back(sequences: DataFrame, encoder: dict | None = None) -> DataFrame:
    """Digests of each conversation as parsed from the formatted sequences alone, with the encoder that they were made with."""
    parts = cut(sequences.select("text", "ids", "nodes", "leaves").mapInArrow(lambda b: _read(b, encoder), PARTS))
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    whole = parts.where("turns_sha256 is not null").select(*names)
    split = parts.where("turns_sha256 is null").repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_joined, DIGESTS)
    return whole.union(split)
