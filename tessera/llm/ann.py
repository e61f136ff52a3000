"""Approximate nearest neighbours by cosine: stable projections in a kd-tree, verified in order until a chi-square test.

On unit vectors the largest cosine is the least Euclidean distance. Projecting with normally distributed weights keeps
distances in this sense: the squared projected distance over the squared distance is chi-square distributed, with as many
degrees of freedom as there are projections (8). Neighbours are verified on the original vectors in the order of the
kd-tree's nodes in projected space; the search of a query stops once the next node is so far that a point there would be
nearer than the k-th best only with probability 1 - confidence.

The tree's upper part is fitted on a bounded sample, 16 rows for each cell, those whose ids have the least hashes; each row
is indexed in its cell, in blocks of about `block` rows. The tree has a cell for each block of rows, `cells` of them at most
(beyond 500 million rows its cells take several blocks). A query first searches a block of its own cell, which bounds its
k-th distance; then it goes only to the cells that the test leaves, where it shares a block of queries with the others that
were sent there. Neighbours are chosen by the score that is returned, so none loses its place to rounding.

Vectors that are null or zero, hold null or non-finite components, or have another length than most valid rows take no
part, as queries or otherwise; nor do rows with a null id. Repeated rows count once. Of rows with the same vector only the
k + 1 least ids can be among any query's k nearest, so only these are searched, however many there are. An id that stands
for several vectors counts by its nearest, and asks for the nearest to any of them. A query never finds rows of its own
id. Ties go to the smaller id. Components may be of any size: they are scaled by a power of two before they are squared. An
empty table gives no neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import durable

M = 8


@dataclass(frozen=True)
class Search:
    k: int = 5
    confidence: float = 0.97
    block: int = 4096
    node: int = 256
    cells: int = 1 << 17
    queries: int = 1 << 15
    seed: int = 11

    def depth(self, rows: int) -> int:
        return max(0, min(math.ceil(math.log2(max(1, rows / self.block))), int(math.log2(self.cells))))


def chi_square_cdf(x: float, m: int = M) -> float:
    """For an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))


def chi_square_quantile(p: float, m: int = M) -> float:
    lo, hi = 0.0, 1e3
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, m) < p else (lo, mid)
    return hi


@dataclass(frozen=True)
class Cells:
    """The upper part of the tree. A node i has children 2 i + 1 and 2 i + 2; lanes and cuts are those of inner nodes, the
    boxes low and high those of all nodes; the last 2 ** depth nodes are the cells."""

    depth: int
    lanes: np.ndarray
    cuts: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, depth: int) -> Cells:
        inner, every = (1 << depth) - 1, (2 << depth) - 1
        lanes, cuts = np.zeros(inner, np.int64), np.zeros(inner)
        low, high = np.full((every, M), -np.inf), np.full((every, M), np.inf)
        own = {0: points}
        for node in range(inner):
            p = own.pop(node)
            lanes[node] = lane = int(np.argmax(p.var(axis=0))) if len(p) > 1 else node % M
            cuts[node] = cut = float(np.median(p[:, lane])) if len(p) else 0.0
            left, right = 2 * node + 1, 2 * node + 2
            low[left] = low[right] = low[node]
            high[left] = high[right] = high[node]
            high[left, lane] = low[right, lane] = cut
            own[left], own[right] = p[p[:, lane] < cut], p[p[:, lane] >= cut]
        return cls(depth, lanes, cuts, low, high)

    def of_points(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (p[np.arange(len(p)), self.lanes[node]] >= self.cuts[node])
        return node - (1 << self.depth) + 1

    def within(self, p: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) for all cells whose squared distance from the point is at most its reach; the tree is descended
        only where that is so."""
        at, node = np.arange(len(p)), np.zeros(len(p), np.int64)
        for level in range(self.depth + 1):
            out = np.zeros(len(at))
            for lane in range(M):
                x = p[at, lane]
                out += np.maximum(np.maximum(self.low[node, lane] - x, x - self.high[node, lane]), 0) ** 2
            near = out <= reach[at]
            at, node = at[near], node[near]
            if level < self.depth:
                at, node = np.repeat(at, 2), (2 * node[:, None] + np.array([1, 2])).ravel()
        return at, node - (1 << self.depth) + 1


def box_distances(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    out = np.zeros((len(p), len(low)))
    for lane in range(p.shape[1]):
        x = p[:, lane, None]
        out += np.maximum(np.maximum(low[:, lane] - x, x - high[:, lane]), 0) ** 2
    return out


def tree_nodes(p: np.ndarray, most: int) -> list[np.ndarray]:
    out, stack = [], [np.arange(len(p))]
    while stack:
        own = stack.pop()
        if len(own) <= most:
            out.append(own)
            continue
        lane = int(np.argmax(np.ptp(p[own], axis=0)))
        half = np.argpartition(p[own, lane], len(own) // 2)
        stack += [own[half[: len(own) // 2]], own[half[len(own) // 2 :]]]
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their greatest component near 1: exact, and no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of a with rows of b, both scaled: the score that is returned."""
    norm = lambda v: np.sqrt(np.einsum("ij,ij->i", v, v))
    return np.einsum("ij,ij->i", a, b) / (norm(a) * norm(b))


def keep_best(place: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, rank, id, score) of the k best different ids of each place."""
    order = np.lexsort((ids, -score, place))
    place, ids, score = place[order], ids[order], score[order]
    by_id = np.lexsort((np.arange(len(ids)), ids, place))
    again = np.zeros(len(ids), bool)
    again[by_id[1:]] = (place[by_id[1:]] == place[by_id[:-1]]) & (ids[by_id[1:]] == ids[by_id[:-1]])
    place, ids, score = place[~again], ids[~again], score[~again]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    rank = np.arange(len(place)) - np.repeat(first, np.diff(np.append(first, len(place))))
    top = rank < k
    return place[top], rank[top], ids[top], score[top]


def search_block(q: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, x: np.ndarray, ids: np.ndarray, weights: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, score) of up to k nearest rows of a block for each query. bound: squared distances that
    the k-th neighbour is known not to exceed."""
    k, limit = search.k, chi_square_quantile(search.confidence)
    sq, sx = scaled(q), scaled(x)
    uq, ux = unit(q), unit(x)
    pq, px = uq @ weights, ux @ weights
    nodes = tree_nodes(px, search.node)
    lower = box_distances(pq, np.array([px[n].min(axis=0) for n in nodes]), np.array([px[n].max(axis=0) for n in nodes]))
    order = np.argsort(lower, axis=1)
    held, held_id = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
    reach, several = bound.copy(), len(np.unique(ids)) < len(ids)
    for step in range(len(nodes)):
        node = order[:, step]
        active = np.flatnonzero(lower[np.arange(len(q)), node] <= limit * reach)
        if not len(active):
            break
        place, row = [], []
        for n in np.unique(node[active]):
            everyone, own = active[node[active] == n], nodes[n]
            for c in range(0, len(everyone), 2048):
                qs = everyone[c : c + 2048]
                near = ((pq[qs] ** 2).sum(axis=1)[:, None] - 2 * pq[qs] @ px[own].T + (px[own] ** 2).sum(axis=1)) <= limit * reach[qs, None] + 1e-9
                near &= ids[own][None, :] != q_ids[qs, None]
                s = np.where(near, uq[qs] @ ux[own].T, -np.inf)
                # products of matrices round in their own ways: all that may be among the k best go on to their exact score
                kth = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k and not several else np.full(len(qs), -np.inf)
                r, o = np.nonzero(near & (s >= np.maximum(kth, held[qs, -1])[:, None] - 1e-9))
                place.append(qs[r])
                row.append(own[o])
        at, x_at = np.concatenate(place), np.concatenate(row)
        for c in range(0, len(at), 1 << 17):
            p, r = at[c : c + (1 << 17)], x_at[c : c + (1 << 17)]
            own = np.unique(p)
            a, b = np.nonzero(held[own] > -np.inf)
            p2, rank, i, v = keep_best(np.append(own[a], p), np.append(held_id[own[a], b], ids[r]), np.append(held[own[a], b], cosines(sq[p], sx[r])), k)
            held_id[p2, rank], held[p2, rank] = i, v
        reach = np.minimum(reach, np.where(held[:, -1] > -np.inf, np.maximum(2 - 2 * held[:, -1], 0) + 1e-9, np.inf))
    at, rank = np.nonzero(held > -np.inf)
    return at, held_id[at, rank], held[at, rank]


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", search: Search = Search()) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row of `vectors` for which `queries` holds."""
    spark = vectors.sparkSession
    ok = F.col(id_col).isNotNull() & F.coalesce(
        F.forall(vector_col, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)) & F.exists(vector_col, lambda v: v != 0), F.lit(False)
    )
    valid = vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    lengths = valid.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim, n = lengths["dim"], lengths["count"]
    weights = np.random.default_rng(search.seed).normal(size=(dim, M))

    def matrix(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in v], pa.binary())], ["id", "asks", "v"])

    packed = valid.where(F.size("v") == dim).mapInArrow(pack, "id long, asks boolean, v binary").groupBy("id", "v").agg(F.max("asks").alias("asks"))
    # Of a vector only its first k + 1 ids are found. The rank is filtered by itself, so each task drops the others before the
    # shuffle, and a vector that most rows share sends k + 1 rows from each task. Queries stay, whatever their rank.
    order = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    found = packed.withColumn("rank", order).where(F.col("rank") <= search.k + 1).select("id", F.lit(False).alias("asks"), "v", F.lit(True).alias("found"))
    asking = packed.where("asks").select("id", F.lit(True).alias("asks"), "v", F.lit(False).alias("found"))
    rows = durable(found.unionByName(asking))

    depth = search.depth(n)
    share = math.ceil((1 << 30) * min(1.0, 1.2 * (16 << depth) / n))  # of the hashes: a little more than the sample
    hashed = rows.where("found").select("v", F.xxhash64("id").alias("h")).where(F.pmod("h", F.lit(1 << 30)) < share)
    sample = hashed.orderBy(F.pmod("h", F.lit(1 << 30)), "h", "v").limit(16 << depth).select("v")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = unit(matrix(b.column(0))) @ weights
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in p.astype("<f4")], pa.binary())], ["p"])

    got = sample.mapInArrow(project, "p binary").toArrow().column("p").to_pylist()  # 32 bytes for each row
    cells = Cells.of(np.frombuffer(b"".join(got), "<f4").reshape(-1, M).astype(float), depth)
    shared = spark.sparkContext.broadcast(cells)
    limit = chi_square_quantile(search.confidence)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = unit(matrix(b.column(2))) @ weights
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.of_points(p).astype(np.int32))], [*b.schema.names, "cell"])

    placed = durable(rows.select("id", "asks", "v", "found").mapInArrow(place, "id long, asks boolean, v binary, found boolean, cell int"))
    parts_of = lambda size: F.greatest(F.lit(1), F.ceil(size)).cast("int")
    # one row for each cell, `cells` at most
    blocks = F.broadcast(durable(placed.groupBy("cell").agg(parts_of(F.count_if("found") / search.block).alias("parts"), parts_of(F.count_if("asks") / search.queries).alias("q_parts"))))
    index = placed.where("found").join(blocks.select("cell", "parts"), "cell").select("cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "id", F.col("v").alias("x"))
    key = ["cell", "part", "q_part"]

    def run(key_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q_ids = left["query_id"].to_numpy()
        at, ids, score = search_block(matrix(left["v"]), q_ids, left["bound"].to_numpy(), matrix(right["x"]), right["id"].to_numpy(), weights, search)
        return pa.table({"query_id": q_ids[at], "id": ids, "score": score})

    def searched(asked: DataFrame, asked_blocks: DataFrame) -> DataFrame:
        """asked: query_id, v, bound, cell, part. A cell's rows go once to each block of the queries asked of it."""
        left = asked.join(asked_blocks, "cell").withColumn("q_part", F.pmod(F.xxhash64("query_id", F.lit(1)), "q_parts").cast("int"))
        right = index.join(asked_blocks, "cell").withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)))
        again = lambda *c: [F.col(x).alias(x) for x in c]  # noqa: E731  (both sides come from one table)
        met = left.select(*again(*key, "query_id", "v", "bound")).groupBy(*key).cogroup(right.select(*again(*key, "id", "x")).groupBy(*key)).applyInArrow(run, "query_id long, id long, score double")
        return met.groupBy("query_id", "id").agg(F.max("score").alias("score"))

    asked = placed.where("asks").select(F.col("id").alias("query_id"), "v", "cell")
    home = asked.join(blocks.select("cell", "parts"), "cell").withColumn("part", F.pmod(F.xxhash64("query_id"), "parts").cast("int"))
    first = searched(home.select("query_id", "v", F.lit(math.inf).alias("bound"), "cell", "part"), blocks.select("cell", "q_parts"))  # no bound until k neighbours are known
    # the k-th best known; a query with several vectors knows those of all of them
    kth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).alias("rank")
    seen = first.select("query_id", "score", kth).where(F.col("rank") == search.k).select("query_id", (F.greatest(F.lit(0.0), 2 - 2 * F.col("score")) + 1e-9).alias("bound"))
    bounded = asked.join(seen, "query_id", "left").select("query_id", "v", F.coalesce("bound", F.lit(math.inf)).alias("bound"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        step = max(1, (1 << 20) >> tree.depth)  # so that no more than a million pairs are held
        for b in batches:
            p = unit(matrix(b.column(1))) @ weights
            reach = limit * b.column(2).to_numpy()
            for i in range(0, len(b), step):
                q, c = tree.within(p[i : i + step], reach[i : i + step])
                for j in range(0, len(q), 8192):
                    take = pa.array(q[j : j + 8192] + i)
                    yield pa.RecordBatch.from_arrays([*(x.take(take) for x in b.columns), pa.array(c[j : j + 8192].astype(np.int32))], [*b.schema.names, "cell"])

    routed = durable(bounded.mapInArrow(route, "query_id long, v binary, bound double, cell int"))
    sent = F.broadcast(durable(routed.groupBy("cell").agg(parts_of(F.count("*") / search.queries).alias("q_parts"))))
    routed = routed.join(blocks.select("cell", "parts"), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found = searched(routed.select("query_id", "v", "bound", "cell", "part"), sent)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= search.k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
