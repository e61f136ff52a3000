"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Whole lower-cased texts are read as characters; a feature says whether an n-gram (3, 5 or 7 characters, hashed to 2^20
slots) occurs. Its scale is the log ratio of its smoothed shares in both classes, and a logistic regression with a ridge
penalty weighs the scaled features. It is fitted on at most `per_class` labelled rows of each class, those whose ids have
the least hashes, and then moved to the shares that the classes have among all labels.

Null and empty texts have no features and get the score of the intercept. Rows with equal or null ids are each scored on
their own; an empty table gives an empty result, and other columns of the tables, whatever their names, play no part. Texts
of any length are read whole, in pieces that overlap. A training set without one of the classes gives that of the other to
all rows (0.5 if empty).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, labelled_sample, slices

BITS = 20
LENGTHS = (3, 5, 7)


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, and where each text begins; null counts as empty."""
    data, offsets = as_bytes(pc.utf8_lower(texts.fill_null("")))
    data = data[offsets[0] : offsets[-1]]
    begun = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4"), begun[offsets - offsets[0]]


def gram_slots(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, slot at each start) of all n-grams of a block of characters."""
    x = data.astype(np.uint32) + np.uint32(1)
    h = x.copy()
    for n in range(2, LENGTHS[-1] + 1):
        if len(data) < n:
            return
        h = h[:-1] * np.uint32(0x01000193) + x[n - 1 :]
        if n in LENGTHS:
            y = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            yield n, (y ^ (y >> np.uint32(12))) >> np.uint32(32 - BITS)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted, each once; for keys that mostly repeat a sort is far faster than numpy's hash table."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def features(texts: pa.Array, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each chosen slot that a text has, once. chosen: the feature of a slot, or -1."""
    data, offsets = characters(texts)
    width = int(chosen.max(initial=0)) + 1
    found = [np.zeros(0, np.int64)]
    for rows, starts, ends in slices(offsets, LENGTHS[-1] - 1):
        if ends[-1] == starts[0]:
            continue
        local = ends - starts[0]
        keys = []
        for n, slot in gram_slots(data[starts[0] : ends[-1]]):
            f = chosen[slot]
            at = np.flatnonzero(f >= 0)
            r = np.searchsorted(local, at, "right")
            inside = at + n <= local[r]
            keys.append(rows[r[inside]] * width + f[at[inside]])
        if keys:
            found.append(distinct(np.concatenate(keys)))
    key = distinct(np.concatenate(found))
    return key // width, key % width


@dataclass(frozen=True)
class ToxicityModel:
    chosen: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, f = features(texts, self.chosen)
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(row, self.weights[f], minlength=len(texts)), -500, 500)))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights (of unscaled features) and bias by accelerated gradient descent with an adaptive step."""
    n, width = len(y), len(scale)
    x = scale[cols]
    w, b = np.zeros(width), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    v, c, t, step, last = w, b, 1.0, 1.0, np.inf
    for _ in range(rounds):
        z = np.bincount(rows, x * v[cols], minlength=n) + c
        loss = np.mean(np.logaddexp(0, z) - y * z) + ridge / 2 * v @ v
        if loss > last + 1e-12:  # too far: halve the step and restart from the last good point
            step, t, v, c, last = step / 2, 1.0, w, b, np.inf
            if step < 1e-6:
                break
            continue
        last = loss
        e = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        w2, b2 = v - step * (np.bincount(cols, x * e[rows], minlength=width) + ridge * v), c - step * e.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w * scale, b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 3000, width: int = 1 << 14, least: int = 4, least_ratio: float = 0.7, ridge: float = 2e-5) -> ToxicityModel:
    """per_class bounds the rows fitted on; width bounds the features: of those that
    occur in `least` texts and whose log ratio is at least least_ratio, those whose class shares differ most surely."""
    rows, in_all = labelled_sample(docs, labels, id_col, text_col, label_col, per_class)
    sample = rows.select("y", "text").repartition(12, F.xxhash64("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        every = np.arange(1 << BITS, dtype=np.int32)
        for b in batches:
            y = b.column(0).to_numpy()
            n += np.bincount(y, minlength=2)
            for k in range(0, len(b), 64):
                row, f = features(b.column(1).slice(k, 64), every)
                for c in (0, 1):
                    have[c] += np.bincount(f[y[k : k + 64][row] == c], minlength=1 << BITS).astype(np.int32)
        for c in (0, 1):
            if n[c]:
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([int(n[c])]), pa.array([have[c].tobytes()], pa.binary())], ["y", "n", "have"])

    have, n = np.zeros((2, 1 << BITS)), np.zeros(2)
    for r in sample.mapInArrow(count, "y int, n long, have binary").toLocalIterator():
        have[r["y"]] += np.frombuffer(r["have"], np.int32)
        n[r["y"]] += r["n"]
    if not n.all():
        return ToxicityModel(np.full(1 << BITS, -1, np.int32), np.zeros(1), 0.0 if not n.any() else (50.0 if n[1] else -50.0))
    share = (have + 1) / (n[:, None] + 2)
    ratio = np.log(share[1] / share[0])
    spread = np.sqrt((1 - share[0]) / (have[0] + 1) + (1 - share[1]) / (have[1] + 1))
    sure = np.where((have.sum(axis=0) >= least) & (np.abs(ratio) >= least_ratio), np.abs(ratio) / np.maximum(spread, 1e-9), 0.0)
    best = np.argsort(-sure, kind="stable")[:width]
    best = np.sort(best[sure[best] > 1.5])
    chosen = np.full(1 << BITS, -1, np.int32)
    chosen[best] = np.arange(len(best))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, f = features(b.column(1), chosen)
            ends = np.searchsorted(row, np.arange(len(b) + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[s:e].astype(np.int32).tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["y", "f"])

    y, parts = [], []
    for r in sample.mapInArrow(select, "y int, f binary").toLocalIterator():
        y.append(r["y"])
        parts.append(np.frombuffer(r["f"], np.int32))
    rows_ = np.repeat(np.arange(len(y)), [len(p) for p in parts])
    weights, bias = fit_logistic(rows_, np.concatenate(parts), ratio[best], np.array(y, float), ridge)
    bias += np.log(in_all[1] / in_all[0]) - np.log(n[1] / n[0])  # where the sample holds the classes in other shares
    return ToxicityModel(chosen, weights.astype(np.float64), bias)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """id_col, the kept columns, and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 2 ** 20 slots and `width` weights

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(m.scores(b.column(b.num_columns - 1)))], [*b.schema.names[:-1], "score"])

    rows = docs.select(F.col(id_col), *[c.alias(k) for k, c in (keep or {}).items()], F.col(text_col).cast("string").alias("text__"))
    types = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes[:-1])
    return rows.mapInArrow(scan, f"{types}, score double")
