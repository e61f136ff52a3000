"""Rating curves of river sections: what flows through a surveyed profile at each level of water, channel and floodplains apart."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAVITY = 9.81


@dataclass(frozen=True)
class Flow:
    """Roughness (Manning's n) of channel and floodplains; step between levels and how far they go above the lower bank, in m;
    froude: the greatest Froude number of the channel (None: any)."""

    channel: float = 0.035
    plain: float = 0.06
    step: float = 0.1
    above: float = 4.0
    froude: float | None = None


def wetted(level: Column, za: Column, zb: Column, dx: Column) -> tuple[Column, Column, Column]:
    """Area, wetted perimeter and width of water over a stretch of ground that falls evenly from za to zb."""
    da, db = level - za, level - zb
    deep = F.greatest(da, db)
    share = F.when((da > 0) & (db > 0), 1.0).when(deep > 0, deep / F.abs(da - db)).otherwise(0.0)
    area = F.when((da > 0) & (db > 0), (da + db) / 2 * dx).when(deep > 0, deep * share * dx / 2).otherwise(0.0)
    bed = F.when((da > 0) & (db > 0), F.hypot(dx, zb - za)).when(deep > 0, F.hypot(share * dx, deep)).otherwise(0.0)
    return area, bed, share * dx


def rating_curves(points: DataFrame, sections: DataFrame, flow: Flow = Flow()) -> DataFrame:
    """section, level (k-th step above the deepest point between the banks), depth, q, q_channel, area, width, open. points: section, s (m along
    it, different), z; sections: section, left and right (s of the bank points), slope. q never falls with the level: it is the greatest so far.

    Water fills the channel between the banks, and beyond a bank that it tops the ground as far as it is below the water without
    a break. open: it reaches an end of the profile. A point without z is a wall. Each stretch of ground is measured at each
    level at once; the highest ground between it and the bank tells whether water gets there. Sections without both banks,
    or of no slope, have no curve."""
    known = sections.where("left < right and slope > 0")
    inf = F.lit(math.inf)
    p = points.join(known, "section").withColumn("z_", F.coalesce("z", inf))
    zone = F.when(F.col("s") < F.col("left"), -1).when(F.col("s") > F.col("right"), 1).otherwise(0)
    along = Window.partitionBy("section").orderBy("s")
    out = Window.partitionBy("section").orderBy("s").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    p = p.withColumn("zone_", zone)
    # the highest ground from a bank outwards to each point, the bank included
    inner = F.when(F.col("s") >= F.col("right"), F.col("z_"))
    p = p.withColumns({"right_top_": F.max(inner).over(along), "left_top_": F.max(F.when(F.col("s") <= F.col("left"), F.col("z_"))).over(out)})
    edges = Window.partitionBy("section")
    p = p.withColumns({"bed_": F.min(F.when(F.col("zone_") == 0, F.col("z_"))).over(edges), "zl_": F.max(F.when(F.col("s") == F.col("left"), F.col("z_"))).over(edges), "zr_": F.max(F.when(F.col("s") == F.col("right"), F.col("z_"))).over(edges), "all_l_": F.max("left_top_").over(edges), "all_r_": F.max("right_top_").over(edges)})
    p = p.where((F.col("bed_") < inf) & (F.col("zl_") < inf) & (F.col("zr_") < inf))
    ahead = lambda c: F.lead(c).over(along)
    ground = p.withColumns({"zb_": ahead("z_"), "dx_": ahead("s") - F.col("s"), "next_": ahead("s"), "outer_": ahead("left_top_")}).where("dx_ is not null")
    side = F.when(F.col("next_") <= F.col("left"), -1).when(F.col("s") >= F.col("right"), 1).otherwise(0)
    # what water must top to reach a stretch: the ground from the bank to its nearer end
    ground = ground.withColumn("side_", side).withColumn("must_", F.when(side == -1, F.col("outer_")).when(side == 1, F.col("right_top_")).otherwise(F.lit(-math.inf)))
    steps = F.ceil((F.least("zl_", "zr_") - F.col("bed_") + flow.above) / flow.step - 1e-9).cast("int")
    wide = ground.withColumn("level", F.explode(F.sequence(F.lit(0), steps))).withColumn("depth", F.round(F.col("level") * flow.step, 6))
    water = F.col("bed_") + F.col("depth")
    here = (water > F.col("must_")) & (F.col("z_") < inf) & (F.col("zb_") < inf)
    area, bed, width = wetted(water, F.col("z_"), F.col("zb_"), F.col("dx_"))
    zero = lambda c: F.when(here, c).otherwise(0.0)
    unbounded = ((water > F.col("all_l_")) | (water > F.col("all_r_")))
    zones = wide.groupBy("section", "level", "depth", "side_", "slope").agg(F.sum(zero(area)).alias("a_"), F.sum(zero(bed)).alias("p_"), F.sum(zero(width)).alias("w_"), F.max(unbounded).alias("open_"))
    rough = F.when(F.col("side_") == 0, flow.channel).otherwise(flow.plain)
    q = F.when((F.col("a_") > 0) & (F.col("p_") > 0), F.col("a_") / rough * F.pow(F.col("a_") / F.col("p_"), F.lit(2 / 3)) * F.sqrt("slope")).otherwise(0.0)
    if flow.froude is not None:
        most = flow.froude * F.col("a_") * F.sqrt(GRAVITY * F.col("a_") / F.col("w_"))
        q = F.when((F.col("side_") == 0) & (F.col("w_") > 0), F.least(q, most)).otherwise(q)
    levels = zones.withColumn("q_", q).groupBy("section", "level", "depth").agg(F.sum("q_").alias("q_"), F.sum(F.when(F.col("side_") == 0, F.col("q_")).otherwise(0.0)).alias("q_channel"), F.sum("a_").alias("area"), F.sum("w_").alias("width"), F.max("open_").alias("open"))
    rising = Window.partitionBy("section").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return levels.withColumn("q", F.max("q_").over(rising)).select("section", "level", "depth", "q", "q_channel", "area", "width", "open")
