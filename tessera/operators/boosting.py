"""Boosted trees on histograms, with monotone features, and their probabilities out of fold.

A row's features are cut into bins once, at exact quantiles of all rows, and rows of the same bins, fold and outcome are
counted: no tree tells them apart. A round adds one tree to each model, level by level: every task sums the gradients of
its counted rows by (model, node, feature, bin), the sums of all tasks meet in one aggregate, and only that histogram comes
to the driver, whose size has nothing to do with the rows. There each node takes the split that lowers the loss most. All
folds' models grow side by side in the same passes: a row takes part in all models but that of its own fold. The rows
themselves are read again once, at the end, for the probability by their own fold's model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.weighted import quantiles_of_all
from tessera.sources.storage import durable


@dataclass(frozen=True)
class Boosting:
    """rate: share of a leaf's value that counts. least: rows of a leaf. l2: added to the curvature. bins: of a feature. renew:
    rounds after which the rows' sums over trees are stored, so that no pass adds up more trees than that. task: counted rows of a task."""

    rounds: int = 120
    depth: int = 2
    rate: float = 0.05
    least: int = 20
    l2: float = 2.0
    bins: int = 64
    renew: int = 10
    task: int = 10_000


@dataclass
class Tree:
    """A full binary tree; node i has children 2 i + 1 and 2 i + 2, and rows with bin <= cut go left. A node without a split
    (feature -1) sends all rows left."""

    depth: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    leaf: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        inner = (1 << self.depth) - 1
        self.feature, self.cut, self.leaf = np.full(inner, -1), np.zeros(inner, np.int64), np.zeros(inner + 1)

    def nodes(self, x: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row of bins has reached at a depth."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(depth):
            f = self.feature[at]
            at = 2 * at + 1 + ((f >= 0) & (x[rows, f] > self.cut[at]))
        return at

    def values(self, x: np.ndarray) -> np.ndarray:
        return self.leaf[self.nodes(x, self.depth) - len(self.feature)]


@dataclass
class Model:
    """start: log odds of the training rows; None if they all have one outcome, which is then the probability `always`."""

    start: float | None
    always: float
    trees: list[Tree]


@dataclass
class Node:
    g: float
    h: float
    n: int
    low: float = -math.inf
    high: float = math.inf

    def value(self, l2: float) -> float:
        return min(max(-self.g / (self.h + l2), self.low), self.high)

    def loss(self, l2: float) -> float:
        v = self.value(l2)
        return self.g * v + 0.5 * (self.h + l2) * v * v


def best_split(node: Node, hist: np.ndarray, signs: Sequence[int], how: Boosting) -> tuple[int, int, Node, Node] | None:
    """(feature, bin, left, right) of the split of least loss, or None. hist: (feature, bin, sums of g, h and rows). signs: of
    features by which the value must not fall (1) or rise (-1). Of equals the first feature and bin count."""
    below = np.cumsum(hist, axis=1)[:, :-1]
    above = np.array([node.g, node.h, node.n]) - below
    ok = (below[..., 2] >= how.least) & (above[..., 2] >= how.least)
    value = lambda s: np.clip(-s[..., 0] / (s[..., 1] + how.l2), node.low, node.high)
    a, b = value(below), value(above)
    ok &= np.where(np.array(signs)[:, None] > 0, a <= b, np.where(np.array(signs)[:, None] < 0, a >= b, True))
    loss = sum(s[..., 0] * v + 0.5 * (s[..., 1] + how.l2) * v * v for s, v in ((below, a), (above, b)))
    gain = np.where(ok, node.loss(how.l2) - loss, -np.inf)
    if not gain.size or gain.max() <= 1e-12:
        return None
    f, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
    left, right = (Node(float(s[f, cut, 0]), float(s[f, cut, 1]), int(round(s[f, cut, 2])), node.low, node.high) for s in (below, above))
    if signs[f]:
        middle = (a[f, cut] + b[f, cut]) / 2
        if signs[f] > 0:
            left.high, right.low = min(left.high, middle), max(right.low, middle)
        else:
            left.low, right.high = max(left.low, middle), min(right.high, middle)
    return int(f), int(cut), left, right


def binned(df: DataFrame, features: Sequence[str], event: str, fold: str, names: list, edges: list[np.ndarray], keep: Sequence[str]) -> DataFrame:
    """The kept columns, y, fold (its place in names), and x: a byte for the bin of each feature. A null or NaN counts as the least."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = len(keep) + 2
            x = np.empty((len(b), len(features)), np.uint8)
            for k, e in enumerate(edges):
                v = b.column(first + k).fill_null(-math.inf).to_numpy(zero_copy_only=False)
                x[:, k] = np.searchsorted(e, np.where(np.isnan(v), -np.inf, v), "left")
            yield pa.RecordBatch.from_arrays([*b.columns[:first], pa.array([r.tobytes() for r in x], pa.binary())], [*b.schema.names[:first], "x__"])

    place = (F.array_position(F.array(*[F.lit(n) for n in names]), F.col(fold)) - 1).cast("int")
    rows = df.select(*keep, F.col(event).cast("int").alias("y__"), place.alias("fold__"), *[F.col(f).cast("double").alias(f"f{k}__") for k, f in enumerate(features)])
    kinds = dict(df.dtypes)
    return rows.mapInArrow(cut, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + (", " if keep else "") + "y__ int, fold__ int, x__ binary")


def cross_validated(df: DataFrame, features: Sequence[str], event: str, fold: str, signs: Sequence[int] | None = None, keep: Sequence[str] = (), how: Boosting = Boosting()) -> DataFrame:
    """The kept columns, event, fold and p: the probability of the event by the model that was fitted on the rows of all
    other folds. A fold is a group that must not be split; there must be few of them, as each has a model. Rows with a null event or
    fold take no part. Where the other folds have no event p is 0, where they have nothing else it is 1 (0 if there are none)."""
    signs = list(signs or [0] * len(features))
    rows = df.where(F.col(event).isNotNull() & F.col(fold).isNotNull())
    totals = {r[0]: (r["n"], r["hits"]) for r in rows.groupBy(fold).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("int")).alias("hits")).collect()}
    names = sorted(totals)
    edges = [np.unique(quantiles_of_all(rows, f, [k / how.bins for k in range(1, how.bins)])) for f in features]
    models, n, hits = [], sum(x for x, _ in totals.values()), sum(x for _, x in totals.values())
    for name in names:
        rest, own = n - totals[name][0], hits - totals[name][1]
        models.append(Model(math.log(own / (rest - own)) if 0 < own < rest else None, float(rest > 0 and own == rest), []))
    active = [m for m, x in enumerate(models) if x.start is not None]
    wide, size = len(features), how.bins
    if not names:
        return rows.select(*keep, event, fold, F.lit(0.0).alias("p"))
    base = durable(binned(rows, features, event, fold, names, edges, ()).groupBy("y__", "fold__", "x__").agg(F.count("*").alias("n__")))
    base = durable(base.repartition(max(1, -(-base.count() // how.task)))).withColumn("sum__", F.lit(None).cast("binary"))  # few bytes, but much work

    def bins(x: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, wide).astype(np.int64)

    def unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        y, own, x, n, sums = b.columns
        x = bins(x)
        sums = np.tile([m.start or 0.0 for m in models], (len(x), 1)) if sums.null_count else np.frombuffer(b"".join(sums.to_pylist())).reshape(-1, len(models)).copy()
        return y.to_numpy().astype(float), own.to_numpy(), x, n.to_numpy().astype(float), sums

    def added(x: np.ndarray, sums: np.ndarray, since: int) -> np.ndarray:
        for m in active:
            for t in models[m].trees[since:]:
                sums[:, m] += how.rate * t.values(x)
        return sums

    def histogram(growing: dict[int, Tree], depth: int, since: int) -> np.ndarray:
        """(model, node of the level, feature, bin, (g, h, rows)) over all rows."""
        nodes = 1 << depth
        shape = (len(models), nodes, wide, size)

        def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((3, math.prod(shape)))
            for b in batches:
                if not len(b):
                    continue
                y, own, x, n, sums = unpacked(b)
                sums = added(x, sums, since)
                for m, tree in growing.items():
                    use = own != m
                    p = 1 / (1 + np.exp(-sums[use, m]))
                    at = tree.nodes(x[use], depth) - (nodes - 1)
                    for f in range(wide):
                        key = ((m * nodes + at) * wide + f) * size + x[use, f]
                        for k, w in enumerate((n[use] * (p - y[use]), n[use] * p * (1 - p), n[use])):
                            out[k] += np.bincount(key, w, math.prod(shape))
            some = np.flatnonzero(out[2])
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(o[some]) for o in out)], ["key", "g", "h", "n"])

        total = np.zeros((math.prod(shape), 3))
        for r in base.mapInArrow(sums_of, "key long, g double, h double, n double").groupBy("key").agg(F.sum("g"), F.sum("h"), F.sum("n")).collect():
            total[r[0]] = r[1:]
        return total.reshape(*shape, 3)

    since = 0
    for turn in range(how.rounds if active else 0):
        growing = {m: Tree(how.depth) for m in active}
        level: dict[tuple[int, int], Node] = {}
        for depth in range(how.depth):
            hist, nodes, following = histogram(growing, depth, since), (1 << depth) - 1, {}
            if depth == 0:
                level = {(m, 0): Node(*(float(x) for x in hist[m, 0, 0].sum(axis=0)[:2]), n=int(round(hist[m, 0, 0, :, 2].sum()))) for m in active}
            for (m, i), node in level.items():
                split = best_split(node, hist[m, i - nodes], signs, how)
                if split:
                    growing[m].feature[i], growing[m].cut[i], following[m, 2 * i + 1], following[m, 2 * i + 2] = split
                else:
                    following[m, 2 * i + 1] = node
            level = following
        for (m, i), node in level.items():
            growing[m].leaf[i - len(growing[m].feature)] = node.value(how.l2)
        for m in active:
            models[m].trees.append(growing[m])
        if turn + 1 - since >= how.renew and turn + 1 < how.rounds:
            def renewed(batches: Iterator[pa.RecordBatch], since: int = since) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if len(b):
                        _, _, x, _, sums = unpacked(b)
                        sums = added(x, sums, since)
                        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([r.tobytes() for r in sums], pa.binary())], b.schema.names)

            base, since = durable(base.mapInArrow(renewed, base.schema)), turn + 1

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                own, x = b.column(len(keep) + 1).to_numpy(), bins(b.column(len(keep) + 2))
                p = np.empty(len(own))
                for m in np.unique(own):
                    use, model = own == m, models[m]
                    total = np.full(int(use.sum()), model.start or 0.0)
                    for t in model.trees:
                        total += how.rate * t.values(x[use])
                    p[use] = model.always if model.start is None else 1 / (1 + np.exp(-total))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep) + 2], pa.array(p)], [*b.schema.names[: len(keep) + 2], "p"])

    out = binned(rows, features, event, fold, names, edges, keep)
    kinds = dict(out.dtypes)
    out = out.mapInArrow(judged, ", ".join(f"`{c}` {kinds[c]}" for c in (*keep, "y__", "fold__")) + ", p double")
    named = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("fold__") + 1).cast(dict(df.dtypes)[fold])
    return out.select(*keep, F.col("y__").cast(dict(df.dtypes)[event]).alias(event), named.alias(fold), "p")
