"""Which polygon a point lies in: a hierarchical cover of cells as the index of an equality join.

Polygons have several rings, holes among them; a point is inside if it is by the even-odd rule over all rings together.
A polygon is covered by square cells: a cell that no edge touches is wholly inside or outside, and is kept whole at the
size at which that is so; a cell that edges touch is cut into four, down to the least size. So a point meets a polygon by
the cells that hold it, one for each size, and only points in border cells of the least size are tested, against the edges
of that row of cells alone.

Edges that touch a cell are told from those that miss it with a margin, so rounding can make a cell a border cell but
never hide an edge. Points on an edge belong to one side by the half-open rule of the even-odd test.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.storage import durable


@dataclass(frozen=True)
class Cover:
    """cells: poly, level, cx, cy, inside (false: a border cell). strips: poly, cy and edges, the edges that reach into each row
    of the least cells. edges: poly, x1, y1, x2, y2. rank: poly and its order."""

    cells: DataFrame
    strips: DataFrame
    edges: DataFrame
    order: DataFrame
    coarse: float
    levels: int


def edges_of(polygons: DataFrame, poly: str, rings: str) -> DataFrame:
    """poly, x1, y1, x2, y2 of all edges. rings: array of rings, each an array of struct(x, y); a ring need not repeat its first
    corner. Corners that are null or not finite, and edges of no length, are left out."""
    fine = lambda c: c.isNotNull() & (F.abs(c) < float("inf"))
    ring = F.filter("ring_", lambda c: fine(c["x"]) & fine(c["y"]))
    corners = polygons.select(F.col(poly).alias("poly"), F.explode(rings).alias("ring_")).select("poly", ring.alias("a_")).where(F.size("a_") > 1)
    following = F.concat(F.slice("a_", F.lit(2), F.size("a_") - 1), F.slice("a_", 1, 1))
    pairs = corners.select("poly", F.explode(F.arrays_zip("a_", following.alias("b_"))).alias("e_"))
    rows = pairs.select("poly", *[F.col(f"e_.{p}.{c}").cast("double").alias(f"{c}{k}") for k, p in ((1, "a_"), (2, "b_")) for c in ("x", "y")])
    return rows.where("x1 <> x2 or y1 <> y2")


def crossing(edges: Column, x: Column, y: Column) -> Column:
    """Number of edges that a ray from (x, y) towards greater x crosses: each edge holds its lower end, not its upper."""
    right = lambda e: x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
    return F.size(F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & right(e)))


def _touching(side: float) -> Column:
    """Whether an edge reaches into cell (cx, cy) of that side, or may: boxes overlap, and the cell's corners are not all on
    one side of the edge's line."""
    pad = side * 1e-9
    x0, y0 = F.col("cx") * side - pad, F.col("cy") * side - pad
    x9, y9 = (F.col("cx") + 1) * side + pad, (F.col("cy") + 1) * side + pad
    boxes = (F.greatest("x1", "x2") >= x0) & (F.least("x1", "x2") <= x9) & (F.greatest("y1", "y2") >= y0) & (F.least("y1", "y2") <= y9)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    sides = [dx * (y - F.col("y1")) - dy * (x - F.col("x1")) for x in (x0, x9) for y in (y0, y9)]
    slack = (F.abs(dx) + F.abs(dy)) * pad
    return boxes & (F.least(*sides) <= slack) & (F.greatest(*sides) >= -slack)


def cover(polygons: DataFrame, poly: str, rings: str, coarse: float, levels: int) -> Cover:
    """coarse: side of the largest cells; the least have coarse / 2 ** levels. Each round refines only border cells, so there
    are about as many cells as least cells along the borders. Polygons come in the order of their ids."""
    edges = durable(edges_of(polygons, poly, rings))
    number = lambda c, side: F.floor(c / side)
    every = lambda a, b: F.explode(F.sequence(a, b))
    least = coarse / (1 << levels)
    rows = edges.withColumn("cy", every(number(F.least("y1", "y2"), least), number(F.greatest("y1", "y2"), least)))
    strips = durable(rows.groupBy("poly", "cy").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges")))
    boxes = edges.groupBy("poly").agg(*[f(g(f"{c}1", f"{c}2")).alias(f"{c}{k}") for c in ("x", "y") for k, f, g in ((0, F.min, F.least), (9, F.max, F.greatest))])
    wide = boxes.select("poly", every(number(F.col("x0"), coarse), number(F.col("x9"), coarse)).alias("cx"), "y0", "y9")
    cells = wide.select("poly", "cx", every(number(F.col("y0"), coarse), number(F.col("y9"), coarse)).alias("cy"))
    # the edges that may touch a cell go down with it
    near = edges.withColumn("cx", every(number(F.least("x1", "x2"), coarse), number(F.greatest("x1", "x2"), coarse))).withColumn("cy", every(number(F.least("y1", "y2"), coarse), number(F.greatest("y1", "y2"), coarse)))
    done = []
    for level in range(levels + 1):
        side = coarse / (1 << level)
        near = durable(near.where(_touching(side)))
        border = near.select("poly", "cx", "cy").distinct()
        plain = cells.join(border.hint("merge"), ["poly", "cx", "cy"], "left_anti")
        # a plain cell is as its middle is; the row of least cells through the middle has all edges that matter
        middle = plain.withColumns({"mx_": (F.col("cx") + 0.5) * side, "my_": (F.col("cy") + 0.5) * side}).withColumn("row_", number(F.col("my_"), least))
        tested = middle.join(strips.withColumnRenamed("cy", "row_").hint("merge"), ["poly", "row_"]).where(crossing(F.col("edges"), F.col("mx_"), F.col("my_")) % 2 == 1)
        done.append(durable(tested.select("poly", F.lit(level).alias("level"), "cx", "cy", F.lit(True).alias("inside"))))
        if level == levels:
            done.append(durable(border.select("poly", F.lit(level).alias("level"), "cx", "cy", F.lit(False).alias("inside"))))
            break
        quarter = lambda d: d.withColumn("a_", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("b_", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"cx": 2 * F.col("cx") + F.col("a_"), "cy": 2 * F.col("cy") + F.col("b_")}).drop("a_", "b_")
        cells, near = durable(quarter(border)), quarter(near)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return Cover(out, strips, edges, polygons.select(F.col(poly).alias("poly")).distinct(), coarse, levels)


#: Cells that may be broadcast: some 10 MB.
MOST_CELLS = 1 << 18


def _placed(points: DataFrame, ident: str, x: str, y: str) -> DataFrame:
    fine = (F.abs("x_") < float("inf")) & (F.abs("y_") < float("inf"))  # false for NaN, too
    return points.select(F.col(ident).alias("id_"), F.col(x).cast("double").alias("x_"), F.col(y).cast("double").alias("y_")).where(fine)


def containing(points: DataFrame, index: Cover, ident: str, x: str, y: str) -> DataFrame:
    """ident, poly of all polygons that hold each point. Few cells are broadcast, after they are counted; more are joined by
    a shuffle, in which Spark splits cells with many points, and bring the edges of their row along. Joins name their kind, as
    Spark takes rows that were exploded for as small as they were before."""
    few = index.cells.count() <= MOST_CELLS
    sides = [index.coarse / (1 << k) for k in range(index.levels + 1)]
    key = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("x_") / s).alias("cx"), F.floor(F.col("y_") / s).alias("cy")) for k, s in enumerate(sides)]))
    placed = _placed(points, ident, x, y).withColumn("k_", key).select("id_", "x_", "y_", "k_.*")
    within = crossing(F.col("edges"), F.col("x_"), F.col("y_")) % 2 == 1
    if few:
        met = placed.join(F.broadcast(index.cells), ["level", "cx", "cy"])
        tested = met.where("not inside").join(index.strips.hint("merge"), ["poly", "cy"]).where(within)
        return met.where("inside").select("id_", "poly").unionByName(tested.select("id_", "poly")).withColumnRenamed("id_", ident)
    border = index.cells.where("not inside").join(index.strips.hint("merge"), ["poly", "cy"])
    cells = index.cells.where("inside").withColumn("edges", F.lit(None).cast(border.schema["edges"].dataType)).unionByName(border)
    met = placed.join(cells.hint("merge"), ["level", "cx", "cy"])
    return met.where(F.col("inside") | within).select(F.col("id_").alias(ident), "poly")


def _apart2() -> Column:
    """Squared distance of a point to an edge."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = F.least(F.greatest(((F.col("x_") - F.col("x1")) * dx + (F.col("y_") - F.col("y1")) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    return F.pow(F.col("x_") - F.col("x1") - along * dx, F.lit(2.0)) + F.pow(F.col("y_") - F.col("y1") - along * dy, F.lit(2.0))


def locate(points: DataFrame, index: Cover, ident: str, x: str, y: str, reach: float | None = None) -> DataFrame:
    """ident, poly and apart of each point: the first polygon that holds it (apart 0), else the nearest, and how far it is; ties go
    to the first. reach: no polygon farther than that counts (None: any does). poly is null where there is none, or where the point has
    no place. Points with equal ids are each answered by the same polygon: ids should be unique.

    The nearest is sought in squares of growing size: within a radius of one side all edges are in the 3 x 3 squares
    around, so a point is settled once something is found within it, and the few others go on with twice the size."""
    asked = _placed(points, ident, x, y)
    first = containing(points, index, ident, x, y).groupBy(F.col(ident).alias("id_")).agg(F.min("poly").alias("poly")).withColumn("apart", F.lit(0.0))
    found = [durable(first)]
    left = durable(asked.join(found[0].hint("merge"), "id_", "left_anti"))
    span = index.edges.agg(*[f(f"{c}{k}") for c in ("x", "y") for k in (1, 2) for f in (F.min, F.max)]).first()
    side = index.coarse if reach is None else min(index.coarse, reach)
    while span[0] is not None and not left.isEmpty():
        square = lambda c, s=side: F.floor(c / s)
        around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
        asked_at = left.withColumn("a_", around).withColumn("b_", around).withColumns({"cx": square(F.col("x_")) + F.col("a_"), "cy": square(F.col("y_")) + F.col("b_")})
        spread = index.edges.withColumn("cx", F.explode(F.sequence(square(F.least("x1", "x2")), square(F.greatest("x1", "x2"))))).withColumn("cy", F.explode(F.sequence(square(F.least("y1", "y2")), square(F.greatest("y1", "y2")))))
        best = asked_at.join(spread.hint("merge"), ["cx", "cy"]).withColumn("d_", _apart2()).groupBy("id_").agg(F.min(F.struct(F.round(F.sqrt("d_"), 12).alias("apart"), "poly")).alias("b_"))
        near = durable(best.select("id_", "b_.poly", "b_.apart").where(F.col("apart") <= side))
        found.append(near)
        if reach is not None and side >= reach:
            break
        left = durable(left.join(near.hint("merge"), "id_", "left_anti"))
        side = side * 2 if reach is None else min(side * 2, reach)
    out = found[0].select("id_", "poly", "apart")
    for d in found[1:]:
        out = out.unionByName(d.select("id_", "poly", "apart"))
    return points.select(F.col(ident)).join(out.withColumnRenamed("id_", ident).hint("merge"), ident, "left")
