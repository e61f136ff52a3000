"""Document quality by a convolutional network on bytes, in numpy.

Filters of `width` bytes run over chunks of `chunk` bytes that overlap and cover the whole document; each filter's
greatest response in a chunk is kept, and a small hidden layer turns the mean and the maximum of these over all chunks
into one probability. Filters and layers are learned together by Adam, on all chunks of at most `per_class` labelled rows
of each class (those whose ids have the least hashes).

Null and empty texts are one chunk of padding. Rows with equal or null ids are each scored on their own; an empty table gives
an empty result, and other columns of the tables, whatever their names, play no part. Texts of any length are read whole,
64 chunks at a time; fitting, too, holds a bounded part of them. A training set without one of the classes gives that of the other to all rows (0.5 if empty).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, durable, labelled_sample

PAD = 256


@dataclass(frozen=True)
class Shape:
    width: int = 7
    filters: int = 16
    hidden: int = 16
    chunk: int = 256
    overlap: int = 32


def chunk_starts(lengths: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(row, start within the row) of all chunks; each row has at least one."""
    step = shape.chunk - shape.overlap
    n = np.maximum(1, -(-(lengths - shape.overlap) // step))
    row = np.repeat(np.arange(len(lengths)), n)
    return row, (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step


def chunk_bytes(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, start: np.ndarray, shape: Shape) -> np.ndarray:
    """The bytes of chunks and of the window that begins at their last place; PAD beyond the end of the text."""
    at = (offsets[row] + start)[:, None] + np.arange(shape.chunk + shape.width - 1)
    inside = at < offsets[row + 1][:, None]
    if not len(data):
        return np.full(at.shape, PAD, np.int32)
    return np.where(inside, data[np.minimum(at, len(data) - 1)].astype(np.int32), np.int32(PAD))


@dataclass
class Net:
    shape: Shape
    table: np.ndarray  # width x 257 x filters: what each byte at each place adds to a filter
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def convolved(self, x: np.ndarray) -> np.ndarray:
        n = self.shape.chunk
        out = self.table[0].take(x[:, :n], axis=0)
        add = np.empty_like(out)
        for k in range(1, self.shape.width):
            self.table[k].take(x[:, k : k + n], axis=0, out=add, mode="clip")
            out += add
        # windows of padding alone say nothing, except for an empty text
        out[(x[:, :n] == PAD) & (np.arange(n) > 0)] = -1e9
        return out

    def pooled(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self.convolved(x).max(axis=1) + self.bias, 0)

    def logit(self, means: np.ndarray, tops: np.ndarray) -> np.ndarray:
        return np.tanh(np.hstack([means, tops]) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, texts: pa.Array) -> np.ndarray:
        data, offsets = as_bytes(texts)
        row, start = chunk_starts(np.diff(offsets), self.shape)
        pooled = np.concatenate([self.pooled(chunk_bytes(data, offsets, row[k : k + 64], start[k : k + 64], self.shape)) for k in range(0, len(row), 64)]) if len(row) else np.zeros((0, self.shape.filters))
        first = np.flatnonzero(np.diff(row, prepend=-1))
        if not len(first):
            return np.zeros(0)
        means = np.add.reduceat(pooled, first, axis=0, dtype=np.float64) / np.diff(np.append(first, len(row)))[:, None]
        return 1 / (1 + np.exp(-np.clip(self.logit(means, np.maximum.reduceat(pooled, first, axis=0)), -500, 500)))


def strongest(net: Net, data: np.ndarray, offsets: np.ndarray, row: np.ndarray, start: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk and filter its greatest response, before the bias, and the bytes of the window that gave it."""
    shape, value, windows = net.shape, [], []
    for k in range(0, len(row), block):
        x = chunk_bytes(data, offsets, row[k : k + block], start[k : k + block], shape)
        conv = net.convolved(x)
        at = conv.argmax(axis=1)
        value.append(np.take_along_axis(conv, at[:, None], axis=1)[:, 0])
        windows.append(np.stack([np.take_along_axis(x, at + j, axis=1) for j in range(shape.width)]))
    return np.concatenate(value), np.concatenate(windows, axis=1)


class Stored:
    """A text that is read from storage, piece by piece, as often as it is needed. pieces gives (offset, bytes) in order, each
    with the bytes that windows at its end reach into; last tells where the text ends."""

    def __init__(self, pieces: Callable[[], Iterable[tuple[int, bytes]]], length: int, size: int) -> None:
        self.pieces, self.length, self.size = pieces, length, size

    def blocks(self, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """data, offsets, rows and starts of the chunks that begin in each piece."""
        step, total = shape.chunk - shape.overlap, len(chunk_starts(np.array([self.length]), shape)[0])
        for at, raw in self.pieces():
            n = min(self.size // step, total - at // step)
            yield np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), np.zeros(n, np.int64), np.arange(n) * step


class Part(NamedTuple):
    """Of some chunks: greatest responses, the windows that gave them, and the row of each chunk."""

    raw: np.ndarray
    windows: np.ndarray
    doc: np.ndarray


def parts_of(net: Net, texts: list[bytes | Stored]) -> Iterator[Part]:
    """All chunks of the texts of a batch: texts at hand together, each stored one by its pieces."""
    own = [i for i, t in enumerate(texts) if isinstance(t, bytes)]
    if own:
        offsets = np.cumsum([0, *(len(texts[i]) for i in own)])
        doc, start = chunk_starts(np.diff(offsets), net.shape)
        yield Part(*strongest(net, np.frombuffer(b"".join([texts[i] for i in own]), np.uint8), offsets, doc, start), np.array(own)[doc])
    for i, t in enumerate(texts):
        if isinstance(t, Stored):
            for block in t.blocks(net.shape):
                yield Part(*strongest(net, *block), np.full(len(block[2]), i))


def fit(texts: list[bytes | Stored], y: np.ndarray, shape: Shape, epochs: int = 14, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Net:
    """texts: the bytes of each document, or where they are stored; all of its chunks are seen in each epoch. A batch with a stored
    text is gone through twice, for its pooled responses and for their gradients, so that only one piece is held."""
    rng = np.random.default_rng(seed)
    f, h = shape.filters, shape.hidden
    net = Net(shape, rng.normal(0, 0.15, (shape.width, 257, f)).astype(np.float32), np.zeros(f, np.float32), rng.normal(0, (2 * f) ** -0.5, (2 * f, h)), np.zeros(h), rng.normal(0, h**-0.5, h), 0.0)
    names = ("table", "bias", "w1", "b1", "w2", "b2")
    m, v, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            batch_texts = [texts[i] for i in own]
            again = any(isinstance(x, Stored) for x in batch_texts)
            n, means, tops, held = np.zeros(len(own), np.int64), np.zeros((len(own), f)), np.zeros((len(own), f)), []
            for part in parts_of(net, batch_texts):
                pool = np.maximum(part.raw + net.bias, 0)
                first = np.flatnonzero(np.diff(part.doc, prepend=-1))
                docs = part.doc[first]
                n += np.bincount(part.doc, minlength=len(own))
                means[docs] += np.add.reduceat(pool, first, axis=0)
                tops[docs] = np.maximum(tops[docs], np.maximum.reduceat(pool, first, axis=0))
                if not again:
                    held.append(part)
            means /= n[:, None]
            z = np.hstack([means, tops])
            a = np.tanh(z @ net.w1 + net.b1)
            e = (1 / (1 + np.exp(-np.clip(a @ net.w2 + net.b2, -50, 50))) - y[own]) / len(own)
            da = e[:, None] * net.w2 * (1 - a * a)
            dz = da @ net.w1.T
            dtable, dbias, cell = np.zeros((shape.width, 257, f)), np.zeros(f), np.arange(f)[None, :]
            for part in parts_of(net, batch_texts) if again else held:
                value, doc = part.raw + net.bias, part.doc
                pool = np.maximum(value, 0)
                is_top = (pool == tops[doc]) & (pool > 0)
                dpool = dz[doc, :f] / n[doc][:, None] + dz[doc, f:] * is_top
                dpool *= value > 0
                dbias += dpool.sum(axis=0)
                for j in range(shape.width):
                    dtable[j] += np.bincount((part.windows[j] * f + cell).ravel(), dpool.ravel(), minlength=257 * f).reshape(257, f)
            grads = {"table": dtable.astype(np.float32), "bias": dbias, "w1": z.T @ da + 1e-4 * net.w1, "b1": da.sum(axis=0), "w2": a.T @ e + 1e-4 * net.w2, "b2": e.sum()}
            t += 1
            now = rate * (1 - epoch / epochs) + 1e-4
            for name, g in grads.items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                step = now * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.99**t)) + 1e-8)
                old = getattr(net, name)
                setattr(net, name, (old - step).astype(old.dtype) if name in ("table", "bias") else old - step)
    return net


def in_pieces(sample: DataFrame, shape: Shape, size: int) -> DataFrame:
    """h, y, id_, length, at and piece of all texts of the sample, in pieces of `size` bytes, that hold whole chunks."""
    more = shape.overlap + shape.width - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in enumerate(b.column(3).cast(pa.large_binary())):
                raw = text.as_py()
                total = len(chunk_starts(np.array([len(raw)]), shape)[0]) * (shape.chunk - shape.overlap)
                for at in range(0, total, size):
                    yield pa.RecordBatch.from_arrays([*(b.column(c)[row : row + 1] for c in range(3)), pa.array([len(raw)], pa.int64()), pa.array([at], pa.int64()), pa.array([raw[at : at + size + more]], pa.binary())], ["h", "y", "id_", "length", "at", "piece"])

    kind = dict(sample.dtypes)["id_"]
    return sample.select("h", "y", "id_", "text").mapInArrow(cut, f"h long, y int, id_ {kind}, length long, at long, piece binary")


def training_texts(sample: DataFrame, shape: Shape, held: int, size: int) -> tuple[list[bytes | Stored], np.ndarray]:
    """The texts of the sample and their classes, in the order of their hashes. Texts of one piece are at hand, the shortest
    first, up to `held` bytes; the others stay in shared storage."""
    pieces = durable(in_pieces(sample, shape, size))
    rows = sorted(tuple(r) for r in pieces.where("at = 0").select("h", "id_", "y", "length").collect())  # numbers of at most 2 * per_class texts
    here, total = [], 0
    for r in sorted(rows, key=lambda r: (r[3], r[:2])):
        total += r[3]
        if r[3] > size or total > held:
            break
        here.append(r)
    names = {r[:2] for r in here}
    few = {(r["h"], r["id_"]): bytes(r["piece"]) for r in pieces.where(F.col("h").isin([h for h, _ in names])).collect() if (r["h"], r["id_"]) in names} if names else {}

    def stored(h: int, ident: object) -> Callable[[], Iterable[tuple[int, bytes]]]:
        own = pieces.where((F.col("h") == h) & (F.col("id_") == F.lit(ident))).select("at", "piece")
        return lambda: ((r["at"], bytes(r["piece"])) for r in own.orderBy("at").toLocalIterator())

    texts = [few[r[:2]] if r[:2] in few else Stored(stored(r[0], r[1]), r[3], size) for r in rows]
    return texts, np.array([r[2] for r in rows], float)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 1000, shape: Shape = Shape(), held: int = 1 << 26, together: int = 1 << 12) -> Net | float:
    """A net, or the one class that all labelled rows have. held: bytes of text that the driver keeps; what is beyond them is
    read from shared storage whenever it is its turn, `together` chunks at a time."""
    sample, count = labelled_sample(docs, labels, id_col, text_col, label_col, per_class)
    if len(count) < 2:
        return float(next(iter(count), 0.5))
    texts, y = training_texts(sample, shape, held, together * (shape.chunk - shape.overlap))
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    net = fit(texts, y, shape)
    # fitted on classes of like size; the rows have them in other shares
    net.b2 += np.log(count[1] / count[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return net


def score(docs: DataFrame, model: Net | float, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """id_col, the kept columns, and score of every row."""
    rows = docs.select(F.col(id_col), *[c.alias(k) for k, c in (keep or {}).items()], F.col(text_col).cast("string").alias("text__"))
    if not isinstance(model, Net):
        return rows.drop("text__").withColumn("score", F.lit(model))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 30,000 numbers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(m.scores(b.column(b.num_columns - 1)))], [*b.schema.names[:-1], "score"])

    types = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes[:-1])
    return rows.mapInArrow(scan, f"{types}, score double")
