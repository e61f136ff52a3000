"""Flow graphs: closure, accumulation, order, walks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.storage import durable


def closure(edges: DataFrame, src: str = "src", dst: str = "dst", stop: str | None = None, most: int = 64) -> DataFrame:
    """All (src, dst, steps) that walks along the edges reach, each node itself included (0 steps), by doubling of paths:
    a chain of n edges takes log2(n) joins. stop: a boolean column of edges that walks end at."""
    steps = edges.where(F.col(dst).isNotNull()).select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(1).alias("steps"), (F.col(stop) if stop else F.lit(False)).alias("end_")).distinct()
    nodes = edges.select(F.col(src).alias("n")).union(edges.select(F.col(dst).alias("n"))).where("n is not null").distinct()
    paths = steps
    size = paths.count()
    for _ in range(most):
        a, b = paths.alias("a"), paths.alias("b")
        longer = a.join(b, (F.col("a.dst") == F.col("b.src")) & ~F.col("a.end_")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"), (F.col("a.steps") + F.col("b.steps")).alias("steps"), F.col("b.end_").alias("end_"))
        paths = paths.union(longer).groupBy("src", "dst").agg(F.min("steps").alias("steps"), F.min_by("end_", "steps").alias("end_"))
        paths = durable(paths)
        now = paths.count()
        if now == size:
            break
        size = now
    return paths.select("src", "dst", "steps").union(nodes.select("n", F.col("n").alias("m"), F.lit(0)))


def accumulate(paths: DataFrame, nodes: DataFrame, node: str, value: str) -> DataFrame:
    """Sum of a node's own value and those of all nodes upstream of it."""
    return paths.join(nodes.select(F.col(node).alias("src"), F.col(value)), "src").groupBy(F.col("dst").alias(node)).agg(F.sum(value).alias(value))


def tree_sums(nodes: DataFrame, node: str, down: str, value: str) -> DataFrame:
    """node, value (the sum of its own and of all that flows into it) and level (the longest way to it from a source), for nodes
    that each flow into at most one (null: none). Pointers are doubled: after k rounds a node knows the sum and the longest way
    of what lies less than 2^k steps upstream, and who is 2^k steps downstream. So rows stay as many as nodes, and a river of n
    nodes takes log2(n) rounds. Pointers that last longer lead into a cycle, which no river has: a ValueError."""
    now = durable(nodes.select(F.col(node).alias("n"), F.col(down).alias("d"), F.col(value).alias("v"), F.lit(0).alias("l")))
    rounds = now.count().bit_length()
    for k in range(rounds + 1):
        if now.where("d is not null").isEmpty():
            break
        if k == rounds:
            raise ValueError("nodes flow into each other in a cycle")
        arriving = now.where("d is not null").groupBy(F.col("d").alias("n")).agg(F.sum("v").alias("v2"), F.max("l").alias("l2"))
        beyond = now.where("d is not null").select(F.col("n").alias("d"), F.col("d").alias("d2"))
        grown = now.join(arriving, "n", "left").join(beyond, "d", "left")
        total = F.when(F.col("v2").isNull(), F.col("v")).otherwise(F.coalesce("v", F.lit(0)) + F.col("v2"))
        now = durable(grown.select("n", F.col("d2").alias("d"), total.alias("v"), F.greatest("l", F.col("l2") + F.lit(1 << k)).cast("int").alias("l")))
    return now.select(F.col("n").alias(node), F.col("v").alias(value), F.col("l").alias("level"))


def downstream_codes(df: DataFrame, river: str, code: str) -> DataFrame:
    """Edges along each river: a unit flows into the one with the next lower code; the lowest has none."""
    return df.withColumn("next", F.lag(code).over(Window.partitionBy(river).orderBy(code)))


def is_upstream(a, b):
    """Pfafstetter codes: whether basin a lies upstream of b. After the digits they share, a lies inside b with no 0 in
    the rest, or a's digit is greater, all that is left of b is odd, and a has no 0 left."""
    shared = F.array_max(F.transform(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda n: F.when(F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n), n).otherwise(0)))
    rest_a, rest_b = F.substring(a, shared + 1, F.length(a)), F.substring(b, shared + 1, F.length(b))
    inside = (rest_b == "") & ~rest_a.contains("0") & (rest_a != "")
    beyond = (rest_b != "") & (rest_a != "") & (F.substring(rest_a, 1, 1) > F.substring(rest_b, 1, 1)) & rest_b.rlike("^[13579]+$") & ~rest_a.contains("0")
    return F.coalesce(inside | beyond, F.lit(False))


def steepest(df: DataFrame, keys: Sequence[str], height: str, ny: int, nx: int) -> DataFrame:
    """The neighbour to which each cell falls most steeply (of eight; the first in row order, if tied), or null."""
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in around]))
    wide = df.withColumn("o_", o).select(*keys, "j", "i", F.col(height).alias("h_"), (F.col("j") + F.col("o_.a")).alias("tj"), (F.col("i") + F.col("o_.b")).alias("ti"), F.sqrt(F.abs("o_.a") + F.abs("o_.b")).alias("d_"))
    to = df.select(*keys, F.col("j").alias("tj"), F.col("i").alias("ti"), F.col(height).alias("th_"))
    fall = wide.join(to, [*keys, "tj", "ti"]).withColumn("s_", (F.col("h_") - F.col("th_")) / F.col("d_"))
    best = fall.where("s_ > 0").groupBy(*keys, "j", "i").agg(F.min_by(F.struct("tj", "ti", "s_"), F.struct(-F.col("s_"), "tj", "ti")).alias("b"))
    return df.join(best, [*keys, "j", "i"], "left").select(*keys, "j", "i", F.col("b.tj").alias("tj"), F.col("b.ti").alias("ti"), F.col("b.s_").alias("slope"))


def snap(points: DataFrame, field: DataFrame, keys: Sequence[str], value: str, radius: int) -> DataFrame:
    """Moves each point (keys, id, j, i) to the cell within the radius that has the greatest value (the nearest, if tied), in
    the field of its own keys; a point meets only the cells around it."""
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]))
    wide = points.withColumn("o_", o).select(*keys, "id", (F.col("j") + F.col("o_.a")).alias("j"), (F.col("i") + F.col("o_.b")).alias("i"), (F.abs("o_.a") + F.abs("o_.b")).alias("d_"))
    return wide.join(field.hint("merge"), [*keys, "j", "i"]).groupBy(*keys, "id").agg(F.min_by(F.struct("j", "i", value), F.struct(-F.col(value), "d_", "j", "i")).alias("b")).select(*keys, "id", "b.*")


def time_area(cells: DataFrame, keys: Sequence[str], hours: str, area: str) -> DataFrame:
    """Area by whole hours of travel time."""
    return cells.groupBy(*keys, F.floor(hours).cast("int").alias("lag_h")).agg(F.sum(area).alias("km2"))
