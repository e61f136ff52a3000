"""The deepest line of a river along a mapped one, on a raster of heights, and cross-sections that are cut from it.

Places are in cells of the raster: x counts columns and y rows, whole numbers are centres. A line is a key of its own with
stations n = 0, 1, ... along it; windows over a line hold a few stations at a time, so lines can be long."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.storage import durable


@dataclass(frozen=True)
class Trace:
    """reach: how far to each side the bed is sought; along: stations of the running mean that gives the line's direction; across:
    places of the running mean of a cross-profile; median, mean: stations by which the offset is smoothed; near: how far
    from the smoothed offset the lowest ground is taken; pull: height added for each cell away from the mapped line; apart: stations
    nearer than this (in chain) say nothing of the slope; known: lines with fewer stations of known height are not turned."""

    reach: int = 30
    along: int = 21
    across: int = 5
    median: int = 21
    mean: int = 9
    near: int = 4
    pull: float = 0.004
    apart: float = 20.0
    known: int = 5


def sampled(raster: DataFrame, at: DataFrame, keys: Sequence[str], within: Sequence[str]) -> DataFrame:
    """`at` (within, keys, x, y) with z, linear between the four cells around; null where one of them is unknown. A place meets
    its cells by equality, and their shares are added in the order of rows and columns, so equal ground gives equal z whichever
    cell comes first. What is exploded is far more than its files let expect, so no side is broadcast. raster: within, j, i, z,
    each cell once."""
    c = F.col
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    p = at.withColumn("corner_", corner).withColumns({"j": (F.floor("y") + c("corner_.a")).cast("int"), "i": (F.floor("x") + c("corner_.b")).cast("int")})
    p = p.select(*within, *keys, "j", "i", (2 * c("corner_.a") + c("corner_.b")).alias("q_"), (1 - F.abs(c("y") - c("j"))).alias("wy_"), (1 - F.abs(c("x") - c("i"))).alias("wx_"))
    met = p.join(raster.where("z is not null").select(*within, "j", "i", "z").hint("merge"), [*within, "j", "i"])
    share = c("z") * c("wy_") * c("wx_")
    z = met.groupBy(*within, *keys).agg(*[F.sum(F.when(c("q_") == q, share)).alias(f"z{q}_") for q in range(4)], F.count("*").alias("n_"))
    z = z.where("n_ = 4").select(*within, *keys, (c("z0_") + c("z1_") + c("z2_") + c("z3_")).alias("z"))
    return at.join(z.hint("merge"), [*within, *keys], "left")


def _frame(line: Sequence[str], size: int) -> tuple[Column, Column, Window, Window]:
    """Stations that a centred window lacks before the first and after the last, the window, and the whole line."""
    half, order = size // 2, Window.partitionBy(*line).orderBy("n")
    at, count = F.row_number().over(order), F.count("*").over(Window.partitionBy(*line))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0)
    return F.greatest(half + 1 - at, zero), F.greatest(half + at - count, zero).cast("int"), order.rowsBetween(-half, half), whole


def running_mean(value: str, line: Sequence[str], size: int) -> Column:
    """Over `size` stations; the ends go on with their own value."""
    before, after, frame, whole = _frame(line, size)
    return (F.sum(value).over(frame) + before * F.first(value).over(whole) + after * F.last(value).over(whole)) / size


def running_median(value: str, line: Sequence[str], size: int) -> Column:
    before, after, frame, whole = _frame(line, size)
    values = F.concat(F.array_repeat(F.first(value).over(whole), before), F.collect_list(value).over(frame), F.array_repeat(F.last(value).over(whole), after))
    return F.get(F.array_sort(values), F.lit(size // 2))


def directed(stations: DataFrame, line: Sequence[str], size: int) -> DataFrame:
    """Stations with tx, ty, the direction of the smoothed line there. Lines of one station, and stations where the smoothed line
    stands still, have none and are left out."""
    w = Window.partitionBy(*line).orderBy("n")
    s = stations.withColumns({"sx_": running_mean("x", line, size), "sy_": running_mean("y", line, size)})
    turn = lambda v: F.coalesce(F.lead(v).over(w), F.col(v)) - F.coalesce(F.lag(v).over(w), F.col(v))
    s = s.withColumns({"dx_": turn("sx_"), "dy_": turn("sy_")}).withColumn("d_", F.hypot("dx_", "dy_")).where("d_ > 0")
    return s.withColumns({"tx": F.col("dx_") / F.col("d_"), "ty": F.col("dy_") / F.col("d_")}).drop("sx_", "sy_", "dx_", "dy_", "d_")


def _offset(profile: Column, trace: Trace) -> Column:
    """Where the smoothed cross-profile, pulled to the mapped line, is lowest (the first, if tied): cells to the right. Unknown heights
    count as the highest known one, or 0."""
    n, half = 2 * trace.reach + 1, trace.across // 2
    high = F.coalesce(F.array_max(profile), F.lit(0.0))
    full = F.transform(profile, lambda z: F.coalesce(z, high))
    around = lambda k: [F.get(full, F.least(F.greatest(k + d, F.lit(0)), F.lit(n - 1))) for d in range(-half, half + 1)]
    cost = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: sum(around(k)[1:], around(k)[0]) / trace.across + F.abs(k - trace.reach) * trace.pull)
    return F.array_position(cost, F.array_min(cost)) - 1 - trace.reach


def _climbs(df: DataFrame, line: Sequence[str], apart: float, least: int) -> DataFrame:
    """Lines of `least` known heights on which most pairs of stations that are further apart than `apart` rise with chain. A line at a time, counted in
    blocks of 512 stations."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, z = pdf["chain"].to_numpy(float), pdf["z"].to_numpy(float)
        known = np.isfinite(x) & np.isfinite(z)
        x, z = x[known], z[known]
        pairs = rises = 0
        for a in range(0, len(x), 512):
            dx, dz = x[None, :] - x[a : a + 512, None], z[None, :] - z[a : a + 512, None]
            far = dx > apart
            pairs += int(far.sum())
            rises += int((far & (dz > 0)).sum())
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in line}, "climbs": [len(x) >= least and 2 * rises > pairs]})

    kinds = dict(df.dtypes)
    return df.select(*line, "chain", "z").groupBy(*line).applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in line), "climbs boolean"]))


def thalweg(stations: DataFrame, raster: DataFrame, line: Sequence[str], within: Sequence[str], trace: Trace = Trace()) -> DataFrame:
    """line, n, chain, x, y, z, tx, ty, flipped: for each station the place of the bed beside it, its height and the direction.

    stations: line, n, chain (m along it), x, y; raster: within (columns of `line`), j, i, z. The cross-profile of each station
    is sampled at whole offsets; the offset of the lowest place is smoothed along the line, and z is the lowest known ground near it
    (null: none). Offsets and heights are each kept in shared storage, so places are sampled once. A line that climbs was drawn upstream: its chain and directions are turned, so that chain grows downstream."""
    c = F.col
    s = directed(stations.select(*line, "n", "chain", "x", "y"), line, trace.along)
    right = lambda o: {"x": c("x0_") + o * c("ty"), "y": c("y0_") - o * c("tx")}
    placed = s.withColumnsRenamed({"x": "x0_", "y": "y0_"}).repartition(*line, "n")  # lines may be a few tasks, their stations are not
    wide = placed.withColumn("o_", F.explode(F.sequence(F.lit(-trace.reach), F.lit(trace.reach)))).withColumns(right(c("o_")))
    heights = sampled(raster, wide.select(*line, "n", "o_", "x", "y"), [*[k for k in line if k not in within], "n", "o_"], within)
    profile = F.transform(F.array_sort(F.collect_list(F.struct("o_", "z"))), lambda p: p["z"])
    offsets = heights.groupBy(*line, "n").agg(profile.alias("p_")).select(*line, "n", _offset(c("p_"), trace).cast("double").alias("at_"))
    smooth = offsets.withColumn("at_", running_median("at_", line, trace.median)).withColumn("at_", running_mean("at_", line, trace.mean))
    bed = durable(placed.join(smooth.hint("merge"), [*line, "n"]).withColumns(right(c("at_"))))
    beside = bed.withColumn("o_", F.explode(F.sequence(F.lit(-trace.near), F.lit(trace.near)))).withColumns({"x": c("x") + c("o_") * c("ty"), "y": c("y") - c("o_") * c("tx")})
    lowest = sampled(raster, beside.select(*line, "n", "o_", "x", "y"), [*[k for k in line if k not in within], "n", "o_"], within).groupBy(*line, "n").agg(F.min("z").alias("z"))
    out = durable(bed.join(lowest.hint("merge"), [*line, "n"]))
    out = out.join(_climbs(out, line, trace.apart, trace.known).hint("merge"), list(line))
    turned = lambda v: F.when(c("climbs"), -c(v)).otherwise(c(v)).alias(v)
    return out.select(*line, "n", turned("chain"), "x", "y", "z", turned("tx"), turned("ty"), c("climbs").alias("flipped"))


def _near(traced: DataFrame, sections: DataFrame, line: Sequence[str], reach: float) -> DataFrame:
    """Sections (line, section, at) and the stations within reach of them: both are dealt to stretches of 2 reach."""
    size = 2 * reach
    a = sections.select(*line, "section", "at").withColumn("b_", F.explode(F.sequence(F.floor((F.col("at") - reach) / size), F.floor((F.col("at") + reach) / size))))
    b = traced.withColumn("b_", F.floor(F.col("chain") / size))
    return a.join(b, [*line, "b_"]).where(F.abs(F.col("chain") - F.col("at")) <= reach).drop("b_")


def bed_slopes(traced: DataFrame, sections: DataFrame, line: Sequence[str], halves: Sequence[float] = (250.0, 500.0, 750.0), least: int = 9, apart: float = 20.0) -> DataFrame:
    """line, section, half, slope: how much the bed falls per m, as the median over pairs of stations within `half` of the section that
    are further apart than `apart`. Sections with fewer than `least` stations there, or fewer than 5 of known height, have no row; a
    group is the stations of one such stretch."""
    near = _near(traced, sections, line, max(halves)).withColumn("half", F.explode(F.array(*[F.lit(float(h)) for h in halves]))).where(F.abs(F.col("chain") - F.col("at")) <= F.col("half"))
    keys = [*line, "section", "half"]
    kinds = dict(near.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf.dropna(subset=["chain", "z"]).sort_values("chain")
        x, z = known["chain"].to_numpy(float), known["z"].to_numpy(float)
        parts = [(z[k + 1 :] - z[k])[x[k + 1 :] - x[k] > apart] / (x[k + 1 :] - x[k])[x[k + 1 :] - x[k] > apart] for k in range(len(x))]
        steep = np.concatenate(parts) if parts else np.zeros(0)
        enough = len(pdf) >= least and len(x) >= 5 and len(steep)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "slope": [-np.median(steep) if enough else np.nan]})

    return near.select(*keys, "chain", "z").groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "slope double"])).where("not isnan(slope) and slope is not null")


def cut(traced: DataFrame, raster: DataFrame, sections: DataFrame, line: Sequence[str], within: Sequence[str], half: int = 100, reach: float = 1000.0) -> DataFrame:
    """line, section, s, x, y, z: the ground every cell along a section, from the left (s = 0) to the right as one looks downstream.

    sections: line, section, at (chain). A section crosses the bed at the station nearest to it within reach (the first, if tied) at a
    right angle; without one there it has no rows. z is null where the raster ends."""
    c = F.col
    nearest = _near(traced, sections, line, reach).groupBy(*line, "section").agg(F.min_by(F.struct("x", "y", "tx", "ty"), F.struct(F.abs(c("chain") - c("at")), c("n"))).alias("p_"))
    wide = nearest.withColumn("o_", F.explode(F.sequence(F.lit(-half), F.lit(half))))
    at = wide.select(*line, "section", (c("o_") + half).cast("double").alias("s"), (c("p_.x") + c("o_") * c("p_.ty")).alias("x"), (c("p_.y") - c("o_") * c("p_.tx")).alias("y"))
    return sampled(raster, at, [*[k for k in line if k not in within], "section", "s"], within)
