"""Hard negatives by a blocked matrix product in two dimensions: rows by anchors, in chunks of components.

Vectors are made whole numbers, floor(scale * x). Rows and anchors are dealt by label into blocks, in label order, and each block is cut into
panels of `chunk` components. A task multiplies panels of one chunk and gives partial int64 tiles of scores; the tiles of
an anchor block and a row block are added after a shuffle, and each full tile keeps only its best k. A first pass takes the
tiles whose labels overlap and finds each anchor's positives, the best rows of its label. They set a window for each
anchor and positive, and a second pass takes the tiles with other labels and keeps the best negatives in each window. A
tile of one label is made in one pass only.

A row takes part if its id, label and vector are there, its components finite, its vector of the length that most such
rows have (of the greater, if as many have two), and its whole components small enough for 64-bit scores (below 26 million for 64
components). Of rows with one id the one with the least label, then vector, counts, so repeated rows count once. Ties go to the smaller id. An anchor without
positives, or a window without rows, gives nothing; an empty table gives an empty result. Other columns play no part.

Nothing of a whole table is in one place: a task holds panels of one chunk, or the tiles of one pair of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import durable


@dataclass(frozen=True)
class Mining:
    """anchors, rows: of a block. chunk: components of a panel. together: row panels that meet an anchor panel in one task's
    group. A negative's score times `over` is between a positive's times `low` and times `over`."""

    positives: int = 5
    negatives: int = 5
    scale: int = 256
    low: int = 80
    over: int = 100
    anchors: int = 256
    rows: int = 1024
    chunk: int = 32
    together: int = 4


TILE = "a long, r long, tile binary, a_ids binary, a_labels binary, r_ids binary, r_labels binary, seen binary"
PANEL = "a long, r long, c int, panel binary, ids binary, labels binary"


def multiplied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly: in doubles where no sum can leave their 53 bits."""
    if len(a) and len(b) and int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def smallest(x: np.ndarray) -> bytes:
    """The numbers in the narrowest of 2, 4 and 8 bytes, after a byte that says which."""
    top = int(np.abs(x).max()) if x.size else 0
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64).reshape(n, -1)


def longs(raw: bytes | None) -> np.ndarray:
    return np.frombuffer(raw or b"", "<i8")


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest of each row, the earlier of equals, best first."""
    n = scores.shape[1]
    if n <= k:
        return np.argsort(-scores, axis=1, kind="stable")
    kth = np.partition(scores, n - k, axis=1)[:, n - k]
    out = np.empty((len(scores), k), np.int64)
    for i, (row, cut) in enumerate(zip(scores, kth, strict=True)):
        own = np.flatnonzero(row >= cut)
        out[i] = own[np.argsort(-row[own], kind="stable")[:k]]
    return out


def tile_positives(tile: np.ndarray, a_ids: np.ndarray, a_labels: np.ndarray, r_ids: np.ndarray, r_labels: np.ndarray, how: Mining) -> tuple[np.ndarray, ...]:
    """(anchor, id, score) of the best rows of each anchor's label in a tile, whose rows are sorted by id."""
    mine = (a_labels[:, None] == r_labels) & (a_ids[:, None] != r_ids)
    at = best(np.where(mine, tile, -(1 << 62)), how.positives)  # less than any score, and its negative is a long, too
    own = np.take_along_axis(mine, at, axis=1)
    i, j = np.nonzero(own)
    at = at[i, j]
    return a_ids[i], r_ids[at], tile[i, at]


def tile_negatives(tile: np.ndarray, a_ids: np.ndarray, a_labels: np.ndarray, r_ids: np.ndarray, r_labels: np.ndarray, windows: np.ndarray, how: Mining) -> tuple[np.ndarray, ...]:
    """(anchor, positive, its score, negative, its score): the best rows of other labels in each window of a tile.
    windows: place of the anchor in the tile, positive, score."""
    out = []
    for i in np.unique(windows[:, 0]):
        own = windows[windows[:, 0] == i]
        # no window reaches beyond the least lower and the greatest upper end
        near = np.flatnonzero((r_labels != a_labels[i]) & (tile[i] <= own[:, 2].max()) & (how.over * tile[i] >= how.low * own[:, 2].min()))
        near = near[np.argsort(-tile[i, near], kind="stable")]
        score = tile[i, near]
        for _, positive, p in own:
            first = np.searchsorted(-score, -p)
            took = near[first : first + how.negatives]
            took = took[how.over * tile[i, took] >= how.low * p]
            out.append(np.stack([np.full(len(took), a_ids[i]), np.full(len(took), positive), np.full(len(took), p), r_ids[took], tile[i, took]]))
    return tuple(np.concatenate(out, axis=1)) if out else tuple(np.zeros((5, 0), np.int64))


def mine(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label", how: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchors: which rows are anchors, by
    columns of `vectors`; label_col may be an expression."""
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    finite = F.forall(vector_col, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
    whole = F.transform(vector_col, lambda v: F.floor(v.cast("double") * how.scale))
    # five times a score of this many components stays below 2^63
    fits = F.forall(vector_col, lambda v: F.abs(v.cast("double")) * how.scale < F.floor(F.sqrt(F.lit(float(1 << 62) / max(how.over, how.low)) / F.size(vector_col))))
    ok = F.col(id_col).isNotNull() & label.isNotNull() & F.coalesce(finite & (F.size(vector_col) > 0), F.lit(False))
    taken = vectors.where(ok).where(fits)
    sizes = taken.groupBy(F.size(vector_col).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, n = sizes["dim"], sizes["count"]
    own = F.struct(label.cast("long").alias("label"), whole.alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    one = taken.where(F.size(vector_col) == dim).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(own).alias("s"))
    rows = durable(one.select("id", "s.label", "s.v", "s.asks"))
    n_anchors = rows.where("asks").count()
    cuts = list(range(0, dim, how.chunk))

    def in_blocks(part: DataFrame, parts: int) -> DataFrame:
        """The rows in label order; ids are dealt within a label, so that a frequent one fills many blocks."""
        sorted_ = part.withColumn("h", F.xxhash64("id")).repartitionByRange(max(1, parts), "label", "h").sortWithinPartitions("label", "h")
        return sorted_.select("id", "label", "v").coalesce(max(1, parts))  # a session may deal to more parts, whose blocks would not fill

    def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(number, ids, labels, vectors) of blocks of at most `most` rows, in order of ids."""
        number, held, size = TaskContext.get().partitionId() << 24, [], 0

        def put(number: int, held: list) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
            ids, labels, v = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(ids)
            return number, ids[order], labels[order], v[order]

        for b in batches:
            ids, labels = b.column(0).to_numpy(), b.column(1).to_numpy()
            v, j = b.column(2).flatten().to_numpy().reshape(-1, dim), 0
            while j < len(ids):
                k = min(len(ids), j + most - size)
                held.append((ids[j:k], labels[j:k], v[j:k]))
                size, j = size + k - j, k
                if size == most:
                    yield put(number, held)
                    number, held, size = number + 1, [], 0
        if size:
            yield put(number, held)

    def anchor_panels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, labels, v in blocks(batches, how.anchors):
            raw = [pa.array([x] * len(cuts), pa.binary()) for x in (ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(cuts)), pa.array([0] * len(cuts)), pa.array(range(len(cuts)), pa.int32()), pa.array([smallest(v[:, c : c + how.chunk]) for c in cuts]), *raw], ["a", "r", "c", "panel", "ids", "labels"])

    left = durable(in_blocks(rows.where("asks"), -(-n_anchors // how.anchors)).mapInArrow(anchor_panels, PANEL))

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = [longs(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int(x.min()) for x in labels], pa.int64()), pa.array([int(x.max()) for x in labels], pa.int64())], ["a", "low", "high"])

    # three numbers for each block of anchors: a megabyte for ten million anchors
    spans = sorted(tuple(r) for r in left.where("c = 0").select("a", "labels").mapInArrow(span, "a long, low long, high long").collect())
    numbers_of = np.array([s[0] for s in spans], np.int64)
    lows, highs = (np.array([s[k] for s in spans], np.int64) for k in (1, 2))

    def row_panels(same: bool):
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, ids, labels, v in blocks(batches, how.rows):
                lo, hi = labels.min(), labels.max()
                meets = (lows <= hi) & (highs >= lo) if same else ~((lows == highs) & (lows == lo) & (lo == hi))
                raw = [pa.array([x] * len(cuts), pa.binary()) for x in (ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes())]
                panels = pa.array([smallest(v[:, c : c + how.chunk]) for c in cuts])
                for a in numbers_of[meets].tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([a] * len(cuts)), pa.array([number] * len(cuts)), pa.array(range(len(cuts)), pa.int32()), panels, *raw], ["a", "r", "c", "panel", "ids", "labels"])

        return make

    def product(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Partial tiles of one chunk: the panels of some row blocks with that of an anchor block."""
        out = []
        for x in left.to_pylist():
            p = numbers(x["panel"], len(x["ids"]) // 8)
            for y in right.to_pylist():
                tile = multiplied(p, numbers(y["panel"], len(y["ids"]) // 8))
                meta = [x["ids"], x["labels"], y["ids"], y["labels"], x["seen"]] if x["c"] == 0 else [None] * 5
                out.append((y["a"], y["r"], tile.astype("<i8").tobytes(), *meta))
        names = ["a", "r", "tile", "a_ids", "a_labels", "r_ids", "r_labels", "seen"]
        kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 6
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 8, kinds, strict=True)], names)

    n_blocks = -(-n // how.rows)
    groups = max(1, -(-n_blocks // how.together))
    dealt = in_blocks(rows, n_blocks)

    def reduced(same: bool, left: DataFrame, names: list[str]) -> DataFrame:
        """The best of each full tile."""

        def reduce(key: tuple, tiles: pa.Table) -> pa.Table:
            first = tiles.filter(tiles["a_ids"].is_valid()).to_pylist()[0]
            a_ids, a_labels, r_ids, r_labels = (longs(first[k]) for k in ("a_ids", "a_labels", "r_ids", "r_labels"))
            total = np.zeros((len(a_ids), len(r_ids)), np.int64)
            for t in tiles["tile"]:
                total += longs(t.as_py()).reshape(total.shape)
            if same:
                got = tile_positives(total, a_ids, a_labels, r_ids, r_labels, how)
            else:
                got = tile_negatives(total, a_ids, a_labels, r_ids, r_labels, longs(first["seen"]).reshape(-1, 3), how)
            return pa.table([pa.array(x) for x in got], names)

        group = F.pmod(F.xxhash64("r"), F.lit(groups)).alias("g")
        every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")
        x = left.select("a", "c", every, "panel", "ids", "labels", F.when(F.col("c") == 0, F.col("seen")).alias("seen")).withColumn("g", F.col("g").cast("long")).groupBy("a", "c", "g")
        y = dealt.mapInArrow(row_panels(same), PANEL).select("a", "c", group, "r", "panel", "ids", "labels").groupBy("a", "c", "g")
        tiles = x.cogroup(y).applyInArrow(product, TILE)
        return tiles.groupBy("a", "r").applyInArrow(reduce, ", ".join(f"{c} long" for c in names))

    def ranked(found: DataFrame, key: list[str], score: str, id_: str, most: int) -> DataFrame:
        w = Window.partitionBy(*key).orderBy(F.desc(score), id_)
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)

    found = reduced(True, left.withColumn("seen", F.lit(None).cast("binary")), ["anchor_id", "positive_id", "positive_score"])
    positives = durable(ranked(found, ["anchor_id"], "positive_score", "positive_id", how.positives))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = longs(raw.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([a] * len(ids)), pa.array(np.arange(len(ids)))], ["anchor_id", "a", "at"])

    # each block's windows, as triples of longs in one value: of `anchors` anchors at most
    places = left.where("c = 0").select("a", "ids").mapInArrow(named, "anchor_id long, a long, at long")

    def windows(key: tuple, rows: pa.Table) -> pa.Table:
        raw = np.stack([rows[c].to_numpy() for c in ("at", "positive_id", "positive_score")], axis=1).astype("<i8").tobytes()
        return pa.table({"a": pa.array([key[0].as_py()], pa.int64()), "seen": pa.array([raw], pa.binary())})

    seen = positives.join(places, "anchor_id").select("a", "at", "positive_id", "positive_score").groupBy("a").applyInArrow(windows, "a long, seen binary")
    asked = left.join(seen, "a")
    found = reduced(False, asked, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
    return ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", how.negatives).select(*(c.split()[0] for c in schema.split(", ")))
