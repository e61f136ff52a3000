"""Connected components by alternating large and small stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import attach, durable


def _least(edges: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with m, the least v of each u. The centre of a star may have any share of the edges."""
    return attach(edges, durable(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows__"))), "u", total)


def _large(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small(edges: DataFrame, total: int) -> DataFrame:
    joined = _least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), total)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (least node of its component) for each node of the undirected edges (a, b) of longs.

    Each round shortens all paths; it ends when a round changes nothing. Self links and repeated links do no harm.
    """
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        # a star's edges map to themselves, so equal sums mean a fixed point
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        # a round never adds links
        now = durable(_small(durable(_large(now, state[0])), state[0]))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
