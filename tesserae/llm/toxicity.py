"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs, trained in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import IS_SPACE, U64, Words, chunks, crc32_of_id, cut, discard, mix, texts_of

#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 64, 48
#: Hashed rows of the word and character tables, their width, hidden units of each direction.
WORD_ROWS, CHAR_ROWS, EMBED, HIDDEN = 1 << 14, 1 << 16, 6, 8
#: Character n-grams of a word: prefixes of these lengths, and all of GRAM bytes. GRAMS of them are one step's, so a word
#: of more than LONG bytes is cut at symbols and foreign spaces first, and what is still longer takes further steps.
PREFIXES, GRAM, GRAMS = (3, 4, 5, 6), 4, 8
LONG = GRAMS + GRAM - 1
#: Training is on a bounded sample: at most so many toxic and other labelled documents, of so many characters a kind.
TOXIC_ROWS, OTHER_ROWS, SAMPLE_CHARS = 2500, 3500, 12_000_000
#: At least EPOCHS rounds over the sample, and at least STEPS steps. Parts of the sample that start from the others' odds.
EPOCHS, STEPS, BATCH, RATE, SEED, PARTS = 6, 240, 128, 0.01, 11, 4
#: Share of the rate that the tables learn at: they start from log-odds, and learning them fast is learning by heart.
TABLE_RATE = 0.3
FOLDS, HELD_OUT = 3, 1
#: Bytes of the sample's texts that are turned to inputs at once.
PIECE_BYTES = 2 << 20
#: Bytes that are neither letters nor digits: a word is looked up without those around it.
SYMBOL = np.ones(256, bool)
SYMBOL[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _breaks(b: np.ndarray) -> np.ndarray:
    """Bytes that part a long word: ASCII symbols, and spaces beyond ASCII (U+00A0, U+2000-200B, 202F, 205F, 3000)."""
    one, two = np.append(b[1:], 0), np.append(b[2:], [0, 0])[: len(b)]
    pair = (b == 0xC2) & (one == 0xA0)
    three = (b == 0xE2) & (((one == 0x80) & (((two >= 0x80) & (two <= 0x8B)) | (two == 0xAF))) | ((one == 0x81) & (two == 0x9F)))
    three |= (b == 0xE3) & (one == 0x80) & (two == 0x80)
    out = SYMBOL[b] | pair | three
    out[1:] |= pair[:-1] | three[:-1]
    out[2:] |= three[:-2]
    return out


def _parts(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the words, of more than LONG bytes those of their parts; words of breaks alone stay as they are."""
    breaks = _breaks(words.bytes)
    other = np.concatenate([[0], np.cumsum(~breaks)])
    long = (words.end - words.start > LONG) & (other[words.end] > other[words.start])
    edge = np.zeros(len(breaks) + 1, np.int64)
    edge[words.start[long]] += 1
    edge[words.end[long]] -= 1
    inside = ~IS_SPACE[words.bytes] & ~(breaks & (np.cumsum(edge)[:-1] > 0))
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return change[0::2], change[1::2]


class Inputs:
    """The distinct steps (words and further parts of long words) of some texts, and each text's windows over them."""

    def __init__(self, texts: list[bytes]):
        words = Words(texts)
        start, end = _parts(words)
        for _ in range(4):
            end -= SYMBOL[words.bytes[end - 1]] & (end - start > 1)
            start += SYMBOL[words.bytes[start]] & (end - start > 1)
        pieces = np.maximum(1, -(-(end - start - GRAM + 1) // GRAMS))
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        whole = np.repeat(words.spans(start, end), pieces)
        start, end = np.repeat(start, pieces) + nth * GRAMS, np.repeat(end, pieces)
        end = np.minimum(end, start + LONG)
        self.first = np.searchsorted(start, words.text_start)
        key = np.where(nth > 0, mix(words.spans(start, end), 40), whole)
        _, first, self.word = np.unique(key, return_index=True, return_inverse=True)
        start, end, further = start[first], end[first], nth[first] > 0
        length = end - start
        self.row = np.where(further, WORD_ROWS, (whole[first] & U64(WORD_ROWS - 1)).astype(np.int64))
        columns = []
        for n in PREFIXES:
            columns.append(np.where((length >= n) & ~further, (mix(words.spans(start, np.minimum(start + n, end)), 20 + n) & U64(CHAR_ROWS - 1)).astype(np.int64), CHAR_ROWS))
        for k in range(GRAMS):
            at = np.minimum(start + k, end)
            columns.append(np.where(length >= k + GRAM, (mix(words.spans(at, np.minimum(at + GRAM, end)), 30) & U64(CHAR_ROWS - 1)).astype(np.int64), CHAR_ROWS))
        self.chars = np.stack(columns, axis=1).astype(np.int32)
        self.n_words = np.diff(self.first)
        steps = np.where(self.n_words > 0, 1 + np.maximum(0, -(-(self.n_words - WINDOW) // STRIDE)), 0)
        self.text = np.repeat(np.arange(len(texts)), steps)
        nth = np.arange(len(self.text)) - np.repeat(np.cumsum(steps) - steps, steps)
        n = self.n_words[self.text]
        begin = np.minimum(nth * STRIDE, np.maximum(0, n - WINDOW))
        offset = begin[:, None] + np.arange(WINDOW)
        inside = offset < n[:, None]
        at = np.where(inside, self.first[self.text][:, None] + offset, 0)
        self.ids = np.where(inside, self.word[at] if len(self.word) else 0, len(self.row)).astype(np.int32)  # the last row is padding


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """x -> two GRUs -> attention over steps -> logit of a window."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s=0.2: rng.normal(0, s, shape).astype(np.float32)
        h, d = HIDDEN, 2 * EMBED
        self.p = {"words": draw(WORD_ROWS, EMBED, s=0.05), "chars": draw(CHAR_ROWS + 1, EMBED, s=0.05), "bias": np.zeros(1, np.float32), "attend": draw(2 * h), "value": draw(2 * h)}
        self.p["words"] = np.vstack([self.p["words"], np.zeros((1, EMBED), np.float32)])  # the last row is further parts'
        for side in "fb":
            self.p |= {f"wx{side}": draw(d, 3 * h), f"wh{side}": draw(h, 3 * h), f"wb{side}": np.zeros(3 * h, np.float32)}
        self.base, self.slope, self.offset = 0.0, 1.0, 0.0

    def embed(self, row: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of distinct words: their own vector, and the sum of their n-grams' over the root of their number."""
        self.p["chars"][CHAR_ROWS] = 0
        scale = 1 / np.sqrt(np.maximum((chars < CHAR_ROWS).sum(axis=1), 1)).astype(np.float32)
        total = np.zeros((len(row), EMBED), np.float32)
        for k in range(chars.shape[1]):
            total += self.p["chars"][chars[:, k]]
        return np.hstack([self.p["words"][row], total * scale[:, None]]), scale

    def run(self, x: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Logits of windows; x has the inputs of distinct words, ids their numbers, len(x) for padding."""
        p, h = self.p, HIDDEN
        n, t = ids.shape
        real = (ids < len(x)).astype(np.float32)
        attend, value = np.zeros((n, t), np.float32), np.zeros((n, t), np.float32)
        kept = {}
        for side, order in (("f", range(t)), ("b", range(t - 1, -1, -1))):
            table = np.vstack([x @ p[f"wx{side}"] + p[f"wb{side}"], np.zeros((1, 3 * h), np.float32)]).astype(np.float32)
            wh, part = p[f"wh{side}"], slice(0, h) if side == "f" else slice(h, 2 * h)
            both = np.stack([p["attend"][part], p["value"][part]], axis=1)
            state = np.zeros((n, h), np.float32)
            steps = []
            for k in order:
                a, g = table[ids[:, k]], state @ wh
                gate = a[:, : 2 * h] + g[:, : 2 * h]
                np.clip(gate, -30, 30, out=gate)
                np.negative(gate, out=gate)
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
                r, z = gate[:, :h], gate[:, h:]
                c = np.tanh(a[:, 2 * h :] + r * g[:, 2 * h :])
                new = (c + z * (state - c)) * real[:, k : k + 1]
                if keep:
                    steps.append((k, state, r, z, c, g[:, 2 * h :], new))
                state = new
                out = state @ both
                attend[:, k] += out[:, 0]
                value[:, k] += out[:, 1]
            kept[side] = steps
        e = np.where(real > 0, attend, -1e9)
        e = np.exp(e - e.max(axis=1, keepdims=True)) * real
        weight = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-9)
        logit = (weight * value).sum(axis=1) + p["bias"][0]
        return (logit, (kept, real, weight, value)) if keep else logit

    def gradient(self, inputs: tuple, ids: np.ndarray, y: np.ndarray) -> dict:
        """Gradients of the mean logistic loss over windows."""
        row, chars = inputs
        x, scale = self.embed(row, chars)
        logit, (kept, real, weight, value) = self.run(x, ids, keep=True)
        p, h, n = self.p, HIDDEN, len(y)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d = ((_sigmoid(logit) - y) / n).astype(np.float32)
        g["bias"][0] = d.sum()
        d_value = d[:, None] * weight
        d_attend = d_value * (value - (weight * value).sum(axis=1, keepdims=True))
        dx = np.zeros((len(x) + 1, x.shape[1]), np.float32)
        for side in "fb":
            part = slice(0, h) if side == "f" else slice(h, 2 * h)
            wh, wx = p[f"wh{side}"], p[f"wx{side}"]
            flow = np.zeros((n, h), np.float32)
            d_table = np.zeros((len(x) + 1, 3 * h), np.float32)
            for k, state, r, z, c, gn, new in reversed(kept[side]):
                g["attend"][part] += d_attend[:, k] @ new
                g["value"][part] += d_value[:, k] @ new
                flow = (flow + d_attend[:, k : k + 1] * p["attend"][part] + d_value[:, k : k + 1] * p["value"][part]) * real[:, k : k + 1]
                dc = flow * (1 - z) * (1 - c * c)
                dz = flow * (state - c) * z * (1 - z)
                dr = dc * gn * r * (1 - r)
                da = np.hstack([dr, dz, dc])
                dg = np.hstack([dr, dz, dc * r])
                g[f"wh{side}"] += state.T @ dg
                np.add.at(d_table, ids[:, k], da)
                flow = flow * z + dg @ wh.T
            d_table = d_table[:-1]
            g[f"wx{side}"] += x.T @ d_table
            g[f"wb{side}"] += d_table.sum(axis=0)
            dx[:-1] += d_table @ wx.T
        np.add.at(g["words"], row, dx[:-1, :EMBED])
        per = dx[:-1, EMBED:] * scale[:, None]
        for k in range(chars.shape[1]):
            np.add.at(g["chars"], chars[:, k], per)
        return g


def _log_odds(size: int, rows: list[np.ndarray], y: np.ndarray, smooth: float = 3.0) -> np.ndarray:
    """Smoothed log-odds of a document being toxic given that it holds something hashed to each row."""
    seen = np.zeros((2, size))
    for r, label in zip(rows, y, strict=True):
        seen[int(label), r] += 1
    n = np.maximum([(y == 0).sum(), (y == 1).sum()], 1)
    rate = n[1] / n.sum()
    total = seen.sum(axis=0)
    return np.log((seen[1] + smooth * rate) / (total + smooth) / rate) - np.log((seen[0] + smooth * (1 - rate)) / (total + smooth) / (1 - rate))


class _Part:
    """Some documents of one part of the sample, with the odds that the other parts give."""

    def __init__(self, texts: list[bytes], y: np.ndarray, number: int):
        self.inputs, self.y, self.number = Inputs(texts), y, number
        self.docs = np.unique(self.inputs.text)
        first = self.inputs.first
        self.used = [np.unique(self.inputs.word[first[i] : first[i + 1]]) for i in range(len(texts))]
        self.odds: tuple[np.ndarray, np.ndarray] | None = None

    def logits(self, net: Network) -> np.ndarray:
        x, _ = net.embed(self.inputs.row, self.inputs.chars)
        ids = self.inputs.ids
        return np.concatenate([net.run(x, ids[i : i + 4096]) for i in range(0, len(ids), 4096)])

    def best(self, score: np.ndarray) -> np.ndarray:
        """The window of the highest score of each document."""
        order = np.lexsort((score, self.inputs.text))
        return order[np.append(np.flatnonzero(np.diff(self.inputs.text[order])), len(order) - 1)]


def _odds_of(parts: list[_Part]) -> tuple[np.ndarray, np.ndarray]:
    y = np.concatenate([p.y for p in parts])
    words = [np.unique(p.inputs.row[u]) for p in parts for u in p.used]
    chars = [np.unique(p.inputs.chars[u]) for p in parts for u in p.used]
    odds = 0.5 * _log_odds(WORD_ROWS + 1, words, y), 0.5 * _log_odds(CHAR_ROWS + 1, chars, y)
    odds[1][CHAR_ROWS] = 0
    return odds


def _calibrated(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from logits to probabilities, with smoothed targets, by Newton steps."""
    good, bad = (y == 0).sum(), (y == 1).sum()
    target = np.where(y == 1, (bad + 1) / (bad + 2), 1 / (good + 2))
    x = np.stack([logit, np.ones(len(logit))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * (w - [1.0, 0.0]))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def train(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, steps: int = STEPS) -> Network:
    """Multiple-instance training: a document is as toxic as its most toxic window.

    The sample is dealt into PARTS parts, both kinds evenly. The first column of each table starts from log-odds: for a
    part's own documents from those of the other parts, so that the network is fitted to odds as unseen texts have them.
    It is fitted on each document's most toxic window by the network so far (at first by those odds). A logistic curve
    over the logits so found calibrates the probabilities. What is kept starts from the odds of all parts.
    """
    net, rng = Network(), np.random.default_rng(SEED)
    net.base = float(y.mean()) if len(y) else 0.5
    if not len(y) or y.min() == y.max():
        net.p["bias"][0] = np.log(max(net.base, 0.01) / max(1 - net.base, 0.01))
        net.p["value"][:] = 0
        return net
    dealt = np.zeros(len(y), np.int64)
    for kind in (0, 1):
        of = rng.permutation(np.flatnonzero(y == kind))
        dealt[of] = np.arange(len(of)) % PARTS
    parts = []
    for k in range(PARTS):
        of = np.flatnonzero(dealt == k)
        piece = np.cumsum([len(texts[i]) + 16 for i in of]) // PIECE_BYTES
        parts += [_Part([texts[i] for i in of[piece == p]], y[of[piece == p]], k) for p in np.unique(piece)]
    net.p["words"][:, 0] = 0
    net.p["chars"][:, 0] = 0
    for k in range(PARTS):
        others = [p for p in parts if p.number != k]
        odds = _odds_of(others if {0, 1} == {int(v) for p in others for v in p.y} else parts)
        for part in parts:
            if part.number == k:
                part.odds = odds
    parts_with_words = [p for p in parts if len(p.docs)]
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, per_epoch = 0, sum(-(-len(p.docs) // BATCH) for p in parts_with_words)
    windows: list[np.ndarray] = []

    def started(part: _Part, sign: float) -> None:
        net.p["words"][:, 0] += (sign * part.odds[0]).astype(np.float32)
        net.p["chars"][:, 0] += (sign * part.odds[1]).astype(np.float32)

    for epoch in range(max(epochs, -(-steps // max(1, per_epoch))) if per_epoch else 0):
        if epoch % 2 == 0:
            windows = []
            for part in parts_with_words:
                started(part, 1)
                if epoch:
                    score = part.logits(net)
                else:
                    x, _ = net.embed(part.inputs.row, part.inputs.chars)
                    rank = np.append(x[:, 0] + x[:, EMBED], -9).astype(np.float32)
                    score = np.sort(rank[part.inputs.ids], axis=1)[:, -3:].sum(axis=1)
                windows.append(part.best(score))
                started(part, -1)
        for part, window in zip(parts_with_words, windows, strict=True):
            b = part.inputs
            shuffled = rng.permutation(window)
            started(part, 1)
            for lo in range(0, len(window), BATCH):
                pick = np.sort(shuffled[lo : lo + BATCH])
                own, ids = np.unique(b.ids[pick], return_inverse=True)
                ids = ids.reshape(len(pick), -1)
                words = own[own < len(b.row)]
                g = net.gradient((b.row[words], b.chars[words]), ids, part.y[b.text[pick]])
                step += 1
                for k, v in net.p.items():
                    mean[k] += 0.1 * (g[k] - mean[k])
                    square[k] += 0.01 * (g[k] ** 2 - square[k])
                    v -= RATE * (TABLE_RATE if k in ("words", "chars") else 1) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)
            started(part, -1)
    found, label = [], []
    for part in parts_with_words:
        started(part, 1)
        score = part.logits(net)
        found.append(score[part.best(score)])
        label.append(part.y[part.docs])
        started(part, -1)
    if found:
        net.slope, net.offset = _calibrated(np.concatenate(found).astype(float), np.concatenate(label))
    whole = _odds_of(parts)
    net.p["words"][:, 0] += whole[0].astype(np.float32)
    net.p["chars"][:, 0] += whole[1].astype(np.float32)
    net.p["chars"][CHAR_ROWS] = 0
    return net


def score_texts(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probability for each whole text: the most toxic of all its overlapping windows; the base rate without words."""
    out = np.full(len(texts), net.base)
    inputs = Inputs(texts)
    if len(inputs.ids):
        x, _ = net.embed(inputs.row, inputs.chars)
        best = np.full(len(texts), -np.inf)
        for i in range(0, len(inputs.ids), 2048):
            np.maximum.at(best, inputs.text[i : i + 2048], net.run(x, inputs.ids[i : i + 2048]))
        has = np.isfinite(best)
        out[has] = _sigmoid(net.slope * best[has] + net.offset)
    return out


def _sample(docs: DataFrame, labels: DataFrame) -> list:
    """(text, y) of the sampled documents: in hash order, as many of each kind as the bounds on rows and characters allow.

    A doc_id with labels of both kinds is toxic; of the texts that share a doc_id the least counts, so that what comes
    to the driver is bounded whatever repeats.
    """
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    known = known.where(F.pmod(crc32_of_id(), F.lit(FOLDS)) != HELD_OUT).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("doc_id")
    chosen = known.where("y = 1").orderBy(order).limit(TOXIC_ROWS).union(known.where("y = 0").orderBy(order).limit(OTHER_ROWS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    found = cut(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.length("text").alias("n"), "text")).alias("t")).select("doc_id", "y", "t.n", "t.text"))
    left, ids = {0: SAMPLE_CHARS, 1: SAMPLE_CHARS}, []
    for r in found.select("doc_id", "y", "n", order.alias("h")).orderBy("h").collect():  # at most TOXIC_ROWS + OTHER_ROWS rows
        if r["n"] <= left[r["y"]]:
            left[r["y"]] -= r["n"]
            ids.append((r["doc_id"],))
    taken = docs.sparkSession.createDataFrame(ids, "doc_id long")
    sample = found.join(F.broadcast(taken), "doc_id").select("text", "y", "doc_id").orderBy("doc_id").collect()
    discard(found)
    return sample


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text), from the whole text alone.

    The network learns on the driver from a sample of labelled documents, bounded by TOXIC_ROWS, OTHER_ROWS and
    SAMPLE_CHARS characters a kind, chosen by a hash of doc_id outside the held-out fold (crc32(doc_id as text) mod 3 = 1;
    false where doc_id is null). Null texts count as empty. A text without words scores the share of toxic sampled
    documents, 0.5 where no labelled document is known. Every row gets its own row, repeated ones too; equal texts get
    equal scores. Columns but doc_id and text are not read.
    """
    sample = _sample(docs, labels)
    net = train([r["text"].encode() for r in sample], np.array([r["y"] for r in sample], np.int64))
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_texts(model.value, texts_of(batch)))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.pmod(crc32_of_id(), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
