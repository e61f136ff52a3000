"""Near duplicates by SimHash: tiled exact comparison of 64-bit fingerprints.

A document's words are runs of bytes other than ASCII white space, with A-Z as a-z. Each run of three words, repeats
included, is hashed; a bit of the fingerprint is 1 if it is set in over half the hashes. Fingerprints that differ in at
most three bits are linked, and documents that links connect form a component.

Null and empty texts have the fingerprint 0 and are linked like all others. Copies meet as one fingerprint before
anything is compared. Rows with the same id stay rows of their own; a null id never names a component unless all ids of
the component are null, which makes its component_id null. An empty table gives an empty result; ties cannot arise, as a
component is named by its least id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessera.llm.common import attach, durable, shuffle_width
from tessera.llm.graph import components

SEED = 42
SPACE = re.compile(rb"[\x20\x09-\x0d]")
LANES, LANE_BITS = 4, 16
SIDE = LANE_BITS + 1


def word_runs(text: bytes, width: int, limit: int = 1 << 20) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Space-joined words of consecutive parts of a text, with starts and ends of all runs of `width` words."""
    at, kept, some = 0, [], False
    while at < len(text):
        end = len(text)
        if end - at > limit:
            gap = SPACE.search(text, at + limit)
            end = gap.start() if gap else end
        words = kept + text[at:end].lower().split()
        at = end
        if len(words) >= width:
            some = True
            ends = [x - 1 for x in accumulate(len(w) + 1 for w in words)]
            yield b" ".join(words), [0, *(x + 1 for x in ends[:-width])], ends[width - 1 :]
            kept = words[len(words) - width + 1 :] if width > 1 else []
        else:
            kept = words
    if not some and kept:
        line = b" ".join(kept)
        yield line, [0], [len(line)]


def fingerprint(text: bytes, width: int = 3) -> int:
    count, n = np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_intdigest
    for line, starts, ends in word_runs(text, width):
        hashes = np.array([digest(line[s:e], SEED) for s, e in zip(starts, ends, strict=True)], np.uint64)
        n += len(hashes)
        for k in range(0, len(hashes), 8192):
            bits = np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(count * 2 > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """id and fp (the fingerprint as a signed long) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, "id long, fp long")


@F.arrow_udf(LongType())
def fingerprint_of(texts: pa.Array) -> pa.Array:
    """The fp of fingerprints() as a column."""
    return pa.array(np.fromiter((fingerprint(t.as_py() or b"") for t in texts.cast(pa.large_binary())), np.uint64, len(texts)).view(np.int64))


def boxes(cells: np.ndarray, counts: np.ndarray, rows: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Split the lane counts' lattice into boxes of about `rows` fingerprints: the box of each cell, and the boxes'
    least and greatest lane counts. Cells are never split."""
    rows = max(rows, -(-int(counts.sum()) // most))
    box, low, high = np.zeros(len(cells), np.int64), [], []
    stack = [np.arange(len(cells))]
    while stack:
        own = stack.pop()
        lo, hi = cells[own].min(axis=0), cells[own].max(axis=0)
        if counts[own].sum() > rows and (hi > lo).any():
            lane = int(np.argmax(hi - lo))
            order = own[np.argsort(cells[own, lane], kind="stable")]
            values = cells[order, lane]
            half = int(np.searchsorted(np.cumsum(counts[order]), counts[order].sum() / 2))
            cut = values[half] if values[half] > values[0] else values[half] + 1
            stack += [order[values < cut], order[values >= cut]]
            continue
        box[own] = len(low)
        low.append(lo)
        high.append(hi)
    return box, np.array(low), np.array(high)


def near(low: np.ndarray, high: np.ndarray, radius: int) -> list[np.ndarray]:
    """For each box the boxes, itself included, whose lane counts differ by at most `radius` in sum."""
    return [np.flatnonzero(np.maximum(np.maximum(low - high[i], low[i] - high), 0).sum(axis=1) <= radius) for i in range(len(low))]


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int, side: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles, or within one: it connects all that the links connect."""
    own = b is None
    a = a[np.argsort(np.bitwise_count(a), kind="stable")]
    b = a if own else b[np.argsort(np.bitwise_count(b), kind="stable")]
    pa_, pb = np.bitwise_count(a).astype(int), np.bitwise_count(b).astype(int)
    label = np.arange(len(a) + (0 if own else len(b)))
    shift, out = (0 if own else len(a)), []
    for i in range(0, len(a), side):
        x = a[i : i + side]
        for j in range(i if own else 0, len(b), side):
            y = b[j : j + side]
            if pb[j] - pa_[i + len(x) - 1] > radius:
                break
            if pa_[i] - pb[j + len(y) - 1] > radius:
                continue
            hit = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
            if own and i == j:
                hit = np.triu(hit, 1)
            r, c = np.nonzero(hit)
            while len(r):
                apart = label[r + i] != label[c + j + shift]
                r, c = r[apart], c[apart]
                first = np.flatnonzero(np.diff(r, prepend=-1))
                for u, v in zip(r[first] + i, c[first] + j + shift, strict=True):
                    if label[u] != label[v]:
                        label[label == label[v]] = label[u]
                        out.append((u, v - shift))
    if not out:
        return a[:0], a[:0]
    u, v = np.array(out).T
    return a[u], b[v]


def links(fps: DataFrame, radius: int = 3, tile: int = 8192, most_boxes: int = 1024) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp`, as a spanning forest for each pair of tiles.

    A histogram of the set bits in the four 16-bit lanes (at most 17 ** 4 cells, whatever the input) cuts the space into
    at most `most_boxes` boxes, and boxes into tiles of about `tile` fingerprints. Only tiles whose lane counts are
    within the radius are compared, each pair in one step; within it, parts are skipped by the total count.
    """
    spark = fps.sparkSession
    lane = [F.bit_count(F.shiftrightunsigned("fp", LANE_BITS * k).bitwiseAND(F.lit((1 << LANE_BITS) - 1))) for k in range(LANES)]
    code = lane[0]
    for x in lane[1:]:
        code = code * SIDE + x
    coded = fps.select("fp", code.cast("int").alias("cell"))
    histogram = coded.groupBy("cell").count().toPandas()
    if histogram.empty:
        return spark.createDataFrame([], "a long, b long")
    cells, counts = histogram["cell"].to_numpy(), histogram["count"].to_numpy()
    lanes = np.stack([cells // SIDE ** (LANES - 1 - k) % SIDE for k in range(LANES)], axis=1)
    box, low, high = boxes(lanes, counts, tile, most_boxes)
    parts = np.maximum(1, -(-np.bincount(box, counts, minlength=len(low)).astype(np.int64) // tile))
    around = near(low, high, radius)
    of_cell = spark.createDataFrame([(int(c), int(b), int(parts[b])) for c, b in zip(cells, box, strict=True)], "cell int, box int, parts int")
    by_box = spark.createDataFrame([(i, [(int(x), int(parts[x])) for x in near_i]) for i, near_i in enumerate(around)], "box int, near array<struct<box:int,parts:int>>")
    # both have a bounded number of rows: 17 ** 4 cells, most_boxes boxes
    tiles = coded.join(F.broadcast(of_cell), "cell").groupBy("box", F.pmod(F.xxhash64("fp"), "parts").cast("int").alias("part")).agg(F.collect_list("fp").alias("fps"))
    me, you = F.struct("box", "part"), F.struct(F.col("x.box").alias("box"), F.col("other").alias("part"))
    sides = (
        tiles.join(F.broadcast(by_box), "box")
        .select("box", "part", "fps", F.explode("near").alias("x"))
        .select("box", "part", "fps", "x", F.explode(F.sequence(F.lit(0), F.col("x.parts") - 1)).alias("other"))
        .select(F.least(me, you).alias("p"), F.greatest(me, you).alias("q"), "fps")
    )
    pairs = sum(int(parts[i] * parts[x].sum()) for i, x in enumerate(around)) // 2 + 1
    width = int(min(max(shuffle_width(spark), pairs // 8), 20_000))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for b in batches:
            for k in range(len(b)):
                key, fps_ = (b.column(0)[k].as_py(), b.column(1)[k].as_py()), b.column(2)[k].values.to_numpy().view(np.uint64)
                if key[0] == key[1]:
                    u, v = tile_links(fps_, None, radius)
                elif key == last:
                    u, v = tile_links(held, fps_, radius)
                else:
                    last, held = key, fps_
                    continue
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["a", "b"])

    return sides.repartition(width, "p", "q").sortWithinPartitions("p", "q").mapInArrow(compare, "a long, b long")


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """id, fp, root (a fingerprint that stands for the component) and component_id of every row. An id that stands for
    different texts can be the least of several components, which only their roots tell apart."""
    rows = durable(fingerprints(docs, id_col, text_col, width))
    least = durable(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows__")))
    edges = durable(links(least.select("fp"), radius))
    root = components(edges)
    labelled = least.join(root, least["fp"] == root["node"], "left").select("fp", "least", "rows__", F.coalesce("root", "fp").alias("root"))
    # few components have several fingerprints: the minimum is taken over those alone
    many = labelled.join(root.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size__"))
    named = attach(labelled, durable(many), "root", max(1, root.count()), "size__").select("fp", "root", "rows__", F.coalesce("component_id", "least").alias("component_id"))
    # copies without number share one fingerprint
    return attach(rows, durable(named), "fp", max(1, rows.count())).select("id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least id of all rows that links reach) of every row."""
    found = members(docs, id_col, text_col, width, radius)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
