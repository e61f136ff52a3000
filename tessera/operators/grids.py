"""Operators on gridded fields: long tables with a row (j, i) and a value for each cell."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.storage import durable


def disc(radius_km: float, dy_km: float, dx_km: float) -> list[tuple[int, int]]:
    """Offsets (dj, di) of the cells whose centres lie within the radius."""
    nj, ni = int(radius_km // dy_km), int(radius_km // dx_km)
    return [(dj, di) for dj in range(-nj, nj + 1) for di in range(-ni, ni + 1) if math.hypot(dj * dy_km, di * dx_km) <= radius_km + 1e-9]


def _offsets(offsets: Sequence[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(a).alias("dj"), F.lit(b).alias("di")) for a, b in offsets]))


def _clamped(x: Column, n: int) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(n - 1))


def neighbourhood(df: DataFrame, keys: Sequence[str], value: str, offsets: Sequence[tuple[int, int]], ny: int, nx: int, agg=F.max, out: str = "around") -> DataFrame:
    """agg of the values at all offsets of each cell, the edge repeated outwards.

    Each cell is sent to those that it reaches, so one partial aggregate and one shuffle do it, without a join. Sending
    to (j - dj, i - di) leaves out what only the clamped edge reaches, so cells that stand for others beyond the edge are
    sent once for each of those."""
    reach = max((max(abs(a), abs(b)) for a, b in offsets), default=0)
    beyond = lambda c, n: F.when(c == 0, F.sequence(F.lit(-reach), F.lit(0 if n > 1 else reach))).when(c == n - 1, F.sequence(F.lit(n - 1), F.lit(n - 1 + reach))).otherwise(F.array(c))
    wide = df.select(*keys, F.col("j").cast("int").alias("j"), F.col("i").cast("int").alias("i"), F.col(value).alias("v_"))
    wide = wide.withColumn("pj", F.explode(beyond(F.col("j"), ny))).withColumn("pi", F.explode(beyond(F.col("i"), nx))).withColumn("o_", _offsets(offsets))
    to = wide.select(*keys, (F.col("pj") - F.col("o_.dj")).alias("j"), (F.col("pi") - F.col("o_.di")).alias("i"), "v_")
    return to.where((F.col("j") >= 0) & (F.col("j") < ny) & (F.col("i") >= 0) & (F.col("i") < nx)).groupBy(*keys, "j", "i").agg(agg("v_").alias(out))


def shifted(df: DataFrame, keys: Sequence[str], value: str, dj: int, di: int, ny: int, nx: int) -> DataFrame:
    """The field moved by (dj, di), the edge repeated: cell (j, i) takes the value of (j - dj, i - di)."""
    cells = df.select(*keys, "j", "i").withColumn("sj", _clamped(F.col("j") - dj, ny)).withColumn("si", _clamped(F.col("i") - di, nx))
    source = df.select(*keys, F.col("j").alias("sj"), F.col("i").alias("si"), F.col(value))
    return cells.join(source, [*keys, "sj", "si"], "left").select(*keys, "j", "i", value)


def blocks(df: DataFrame, keys: Sequence[str], value: str, size: int, least: float = 0.0) -> DataFrame:
    """Maximum and mean of each block of size x size cells, null if less than that share of it is known."""
    known = F.count(value)
    enough = known >= math.ceil(least * size * size)
    j, i = F.floor(F.col("j") / size).cast("int").alias("j"), F.floor(F.col("i") / size).cast("int").alias("i")
    return df.groupBy(*keys, j, i).agg(known.alias("n"), F.when(enough, F.max(value)).alias("top"), F.when(enough, F.avg(value)).alias("mean"))


def mean_reflectivity(df: DataFrame, keys: Sequence[str], dbz: str, size: int = 2) -> DataFrame:
    """Block means in linear units."""
    j, i = F.floor(F.col("j") / size).cast("int").alias("j"), F.floor(F.col("i") / size).cast("int").alias("i")
    return df.groupBy(*keys, j, i).agg((10.0 * F.log10(F.avg(F.pow(F.lit(10.0), F.col(dbz) / 10.0)))).alias(dbz))


def nearest_points(points: DataFrame, others: DataFrame, k: int, radius_km: float, least_cos: float = 0.5, within: Sequence[str] = ()) -> DataFrame:
    """For each point (id, lat, lon) the k nearest others (oid, olat, olon) within the radius: rank, km.

    Both sides are dealt to square cells at least as wide as a radius, and points look in the nine around them, so the join
    is on equality. Where others are dense the first radius is a small one, by the fullest cell: a point that has k others within it
    is settled, and the few left go on with twice the radius, so the pairs that are made grow with the points, not with the
    density. Of others at one place only the k of least oid can be found. least_cos: least cosine of a latitude that occurs.
    Ties go to the smaller oid."""
    same = Window.partitionBy(*within, "olat", "olon").orderBy("oid")
    others = others.withColumn("n_", F.row_number().over(same)).where(F.col("n_") <= k).drop("n_")

    def cells(lat: str, lon: str, radius: float) -> tuple[Column, Column]:
        dlat = radius / 111.0
        return F.floor(F.col(lat) / dlat).cast("long"), F.floor(F.col(lon) / (dlat / least_cos)).cast("long")

    cy, cx = cells("olat", "olon", radius_km)
    full = others.groupBy(*within, cy.alias("cy"), cx.alias("cx")).count().agg(F.max("count")).first()[0] or 0
    halvings = min(int(math.log(max(full / k, 1), 4)), 20)
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    x = F.radians(F.col("olon") - F.col("lon")) * F.cos(F.radians((F.col("lat") + F.col("olat")) / 2))
    y = F.radians(F.col("olat") - F.col("lat"))
    own = Window.partitionBy(*within, "id")
    out, waiting = None, points
    for halved in range(halvings, -1, -1):
        radius = radius_km / (1 << halved)
        cy, cx = cells("lat", "lon", radius)
        oy, ox = cells("olat", "olon", radius)
        left = waiting.withColumn("o_", _offsets(near)).withColumn("cy", cy + F.col("o_.dj")).withColumn("cx", cx + F.col("o_.di")).drop("o_")
        pairs = left.join(others.withColumn("cy", oy).withColumn("cx", ox).hint("merge"), ["cy", "cx", *within]).withColumn("km", 6371.0 * F.sqrt(x * x + y * y)).where(F.col("km") <= radius)
        found = pairs.withColumn("rank", F.row_number().over(own.orderBy("km", "oid"))).where(F.col("rank") <= k).drop("cy", "cx")
        if halved:
            found = durable(found.withColumn("n_", F.count("*").over(own)).where(F.col("n_") == k).drop("n_"))
            settled = found.where(F.col("rank") == k).select(*within, "id")
            waiting = durable(waiting.join(settled.hint("merge"), [*within, "id"], "left_anti"))
        out = found if out is None else out.unionByName(found)
    return out


def inverse_distance(points: DataFrame, others: DataFrame, value: str, k: int = 6, radius_km: float = 40.0, least_km: float = 1e-3) -> DataFrame:
    """Inverse-square-distance mean of the k nearest known values within the radius."""
    found = nearest_points(points, others.where(F.col(value).isNotNull()), k, radius_km)
    w = 1.0 / F.pow(F.greatest("km", F.lit(least_km)), F.lit(2.0))
    return found.groupBy("id").agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value), F.count("*").alias("n"))


def regrid(weights: DataFrame, values: DataFrame, to: Sequence[str], source: Sequence[str], value: str) -> DataFrame:
    """Resampling by a table of weights, renormalised over the known values."""
    known = F.when(F.col(value).isNotNull(), F.col("w"))
    return weights.join(values, list(source)).groupBy(*to).agg((F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum(known), F.lit(0.0))).alias(value))


def bilinear(df: DataFrame, at: DataFrame, keys: Sequence[str], value: str, ny: int, nx: int) -> DataFrame:
    """Values at fractional (y, x) of the points `at` (keys, id, y, x), each in the field of its own keys, clamped to the
    grid. A point meets the four cells around it by keys and cell, so there are as many results as points."""
    y, x = F.least(F.greatest("y", F.lit(0.0)), F.lit(ny - 1.0)), F.least(F.greatest("x", F.lit(0.0)), F.lit(nx - 1.0))
    j0, i0 = F.least(F.floor(y), F.lit(max(ny - 2, 0))), F.least(F.floor(x), F.lit(max(nx - 2, 0)))
    p = at.withColumn("fy", y - j0).withColumn("fx", x - i0).withColumn("j0", j0).withColumn("i0", i0).withColumn("o_", _offsets([(0, 0), (0, 1), (1, 0), (1, 1)]))
    w = F.when(F.col("o_.dj") == 1, F.col("fy")).otherwise(1 - F.col("fy")) * F.when(F.col("o_.di") == 1, F.col("fx")).otherwise(1 - F.col("fx"))
    p = p.select(*keys, "id", w.alias("w_"), (F.col("j0") + F.col("o_.dj")).cast("int").alias("j"), (F.col("i0") + F.col("o_.di")).cast("int").alias("i"))
    known = F.when(F.col(value).isNotNull(), F.col("w_"))
    return p.join(df.select(*keys, "j", "i", value).hint("merge"), [*keys, "j", "i"]).groupBy(*keys, "id").agg((F.sum(F.col("w_") * F.col(value)) / F.nullif(F.sum(known), F.lit(0.0))).alias(value))


def majority(df: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """The most frequent unit of each cell (the least, if tied), and its share."""
    n = df.groupBy(*keys, unit).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.min_by(unit, F.struct(-F.col("n"), unit)).alias(unit), (F.max("n") / F.sum("n")).alias("share"))


def register(radar: DataFrame, gauges: DataFrame, keys: Sequence[str], ny: int, nx: int, reach: int = 6, least: int = 30, gain: float = 0.03) -> DataFrame:
    """The shift of the radar field (j, i, r) which correlates best with gauges (j, i, g): dj, di, r. Square roots are
    compared, of the radar's 3 x 3 means (unknown cells are dry, the edge is repeated). No shift, if without one fewer than
    `least` gauges have 1 or more on both, or if the best is not better by `gain`; of equals the first counts."""
    box = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    smooth = neighbourhood(radar.withColumn("r", F.coalesce("r", F.lit(0.0))), keys, "r", box, ny, nx, F.avg, "m_").select(*keys, "j", "i", F.sqrt("m_").alias("f_"))
    shifts = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]
    inside = gauges.where(F.col("g").isNotNull() & F.col("j").between(0, ny - 1) & F.col("i").between(0, nx - 1))
    moved = inside.withColumn("o_", _offsets(shifts)).select(*keys, "g", "o_.dj", "o_.di", _clamped(F.col("j") - F.col("o_.dj"), ny).alias("j"), _clamped(F.col("i") - F.col("o_.di"), nx).alias("i"))
    wet = (F.sqrt("g") >= 1) & (F.col("f_") >= 1)
    flat = F.stddev_pop("f_") <= 0
    scores = moved.join(smooth.hint("merge"), [*keys, "j", "i"]).groupBy(*keys, "dj", "di").agg(F.when(flat, -1.0).otherwise(F.corr(F.sqrt("g"), "f_")).alias("c"), F.count_if(wet).alias("n"))
    here = (F.col("dj") == 0) & (F.col("di") == 0)
    best = scores.groupBy(*keys).agg(F.min_by(F.struct("dj", "di", "c"), F.struct(-F.round("c", 9), "dj", "di")).alias("b"), F.max(F.when(here, F.col("c"))).alias("c0"), F.max(F.when(here, F.col("n"))).alias("n"))
    use = (F.col("n") >= least) & (F.col("b.c") - F.col("c0") >= gain)
    return best.select(*keys, F.when(use, F.col("b.dj")).otherwise(0).alias("dj"), F.when(use, F.col("b.di")).otherwise(0).alias("di"), F.when(use, F.col("b.c")).otherwise(F.col("c0")).alias("r"))


def field_bias(pairs: DataFrame, keys: Sequence[str], gauge: str, radar: str, lo: float = 0.2, hi: float = 5.0) -> DataFrame:
    """Mean-field bias: ratio of sums, limited."""
    return pairs.groupBy(*keys).agg(F.least(F.greatest(F.sum(gauge) / F.nullif(F.sum(radar), F.lit(0.0)), F.lit(lo)), F.lit(hi)).alias("bias"), F.count("*").alias("n"))


def kriging_weights(points: np.ndarray, targets: np.ndarray, reach: float, nugget: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (target x point) and variances of ordinary kriging, the sill being 1, by generalised least squares: the known
    mean is the one of least variance, and what is left of each point counts by its covariance with the target."""
    apart = lambda a, b: np.linalg.norm(a[:, None, :] - b[None, :, :], axis=2)
    covariance = lambda d: np.where(d == 0, 1.0, (1 - nugget) * np.exp(-3 * d / reach))
    among, towards = covariance(apart(points, points)), covariance(apart(targets, points))
    lower = np.linalg.cholesky(among + 1e-10 * np.eye(len(points)))
    half = np.linalg.solve(lower, np.column_stack([towards.T, np.ones(len(points))]))
    both = np.linalg.solve(lower.T, half)  # inverse covariance times the targets' covariances, and times ones
    simple, ones = both[:, :-1].T, both[:, -1]
    missing = 1 - simple.sum(axis=1)  # what simple kriging leaves to the mean
    variance = 1 - np.einsum("ij,ij->i", simple, towards) + missing**2 / ones.sum()
    return simple + missing[:, None] * ones / ones.sum(), np.maximum(variance, 0)


def krige(points: DataFrame, targets: DataFrame, keys: Sequence[str], value: str, range_km: float = 40.0, nugget: float = 0.1) -> DataFrame:
    """Ordinary kriging with an exponential variogram (95 % of the sill at range_km): points (keys, y, x in km, value), targets (keys, id, y, x); estimate
    and variance per target. A key's points are one network at one time: a bounded set, which one task solves."""
    schema = ", ".join(f"`{k}` {dict(targets.dtypes)[k]}" for k in keys) + ", id long, estimate double, variance double"

    def solve(known: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        known = known.dropna(subset=[value]).groupby(["y", "x"], as_index=False)[value].mean()
        out = wanted[[*keys, "id"]].copy()
        if known.empty or wanted.empty:
            return out.assign(estimate=np.nan, variance=np.nan)
        weights, variance = kriging_weights(known[["y", "x"]].to_numpy(float), wanted[["y", "x"]].to_numpy(float), range_km, nugget)
        return out.assign(estimate=weights @ known[value].to_numpy(float), variance=variance)

    return points.select(*keys, "y", "x", value).groupBy(*keys).cogroup(targets.select(*keys, "id", "y", "x").groupBy(*keys)).applyInPandas(solve, schema)


def gauge_check(df: DataFrame, keys: Sequence[str], value: str, radar: str, radius_km: float = 15.0) -> DataFrame:
    """keys, id, value, kept. Rejects impossible values (null, below 0, or 1,500 and more); a gauge that is dry (below 0.5) where
    the radar has 15 or more and the median of at least two neighbours is 10 or more; and one over 30 that is above three
    times the greatest of neighbours and radar, plus 20. df: keys, id, y, x (km), value, radar (null: not seen).

    Gauges are judged in the order of their ids, and a rejected one is nobody's neighbour any more. Only suspects can be
    rejected, so a suspect may be judged once all suspects of lesser ids around it are: each round judges all of these at
    once, from neighbour pairs that are found only once, by squares of radius_km. Ids are unique within a key."""
    named = df.select(*keys, "id", "y", "x", F.col(value).cast("double").alias("g_"), F.col(radar).alias("r_"), F.col(value)).withColumn("fine_", F.coalesce((F.col("g_") >= 0) & (F.col("g_") < 1500), F.lit(False)))
    good = named.where("fine_").withColumn("suspect_", (F.col("g_") < 0.5) | (F.col("g_") > 30))
    square = lambda c: F.floor(F.col(c) / radius_km)
    steps = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    asked = good.where("suspect_").withColumn("a_", steps).withColumn("b_", steps).select(*keys, F.col("id").alias("of_"), F.col("y").alias("y0_"), F.col("x").alias("x0_"), F.col("g_").alias("g0_"), F.col("r_").alias("r0_"), (square("y") + F.col("a_")).alias("sy_"), (square("x") + F.col("b_")).alias("sx_"))
    around = good.select(*keys, F.col("id").alias("near_"), "y", "x", "g_", "suspect_", square("y").alias("sy_"), square("x").alias("sx_"))
    close = (F.hypot(F.col("y") - F.col("y0_"), F.col("x") - F.col("x0_")) <= radius_km) & (F.col("near_") != F.col("of_"))
    pairs = durable(asked.join(around, [*keys, "sy_", "sx_"]).where(close).select(*keys, "of_", "g0_", "r0_", "near_", "g_", "suspect_"))
    verdict = None
    waiting = pairs
    while not waiting.isEmpty():
        known = waiting if verdict is None else waiting.join(verdict, [*keys, "near_"], "left")
        out = F.lit(None).cast("boolean") if verdict is None else F.col("out_")
        known = known.withColumn("open_", F.col("suspect_") & (F.col("near_") < F.col("of_")) & out.isNull()).withColumn("here_", F.when(~F.coalesce(out, F.lit(False)), F.col("g_")))
        seen = known.groupBy(*keys, "of_").agg(F.first("g0_").alias("g0_"), F.first("r0_").alias("r0_"), F.max("open_").alias("open_"), F.count("here_").alias("n_"), F.median("here_").alias("mid_"), F.max("here_").alias("top_"))
        dry = (F.col("g0_") < 0.5) & (F.col("r0_") >= 15) & (F.col("mid_") >= 10)
        dumped = (F.col("g0_") > 30) & (F.col("r0_") >= 0) & (F.col("g0_") > 3 * F.greatest("top_", "r0_") + 20)
        judged = seen.where(~F.col("open_")).select(*keys, F.col("of_").alias("near_"), F.coalesce((F.col("n_") >= 2) & (dry | dumped), F.lit(False)).alias("out_"))
        verdict = durable(judged if verdict is None else verdict.unionByName(judged))
        waiting = durable(pairs.join(verdict.select(*keys, F.col("near_").alias("of_")), [*keys, "of_"], "left_anti"))
    kept = F.col("fine_")
    if verdict is not None:
        named = named.join(verdict.withColumnRenamed("near_", "id"), [*keys, "id"], "left")
        kept = kept & ~F.coalesce("out_", F.lit(False))
    return named.select(*keys, "id", value, kept.alias("kept"))


def _box_mean(df: DataFrame, keys: Sequence[str], value: str, half_j: int, half_i: int, ny: int, nx: int, out: str) -> DataFrame:
    """Mean of the box around each cell, the edge repeated: two running sums, to which edge values are added as often as the
    box reaches beyond."""
    rows = df
    for axis, other, half, n, source in (("i", "j", half_i, nx, value), ("j", "i", half_j, ny, "s_")):
        line = Window.partitionBy(*keys, other).orderBy(axis)
        ends = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        beyond = F.greatest(half - F.col(axis), F.lit(0)) * F.first(source).over(ends) + F.greatest(half - (n - 1 - F.col(axis)), F.lit(0)) * F.last(source).over(ends)
        rows = rows.withColumn("s_", F.sum(source).over(line.rangeBetween(-half, half)) + beyond)
    return rows.withColumn(out, F.col("s_") / ((2 * half_i + 1) * (2 * half_j + 1))).drop("s_")


def convective(df: DataFrame, keys: Sequence[str], dbz: str, ny: int, nx: int, half_j: int = 10, half_i: int = 10, strong: float = 40.0) -> DataFrame:
    """Cells (complete fields of ny x nx) within reach of a core, and of at least 15 dBZ. A core has `strong` dBZ or more, or 25
    or more and stands out from the mean of the box around it by a margin that shrinks as that mean grows; it reaches 1 to
    5 cells, the farther the stronger its surroundings (cells count by the steps between them). A field without 25 dBZ
    has none."""
    z = F.coalesce(F.col(dbz), F.lit(-32.0))
    rows = _box_mean(df.withColumn("z_", z).withColumn("l_", F.pow(F.lit(10.0), F.greatest("z_", F.lit(0.0)) / 10.0)), keys, "l_", half_j, half_i, ny, nx, "m_")
    mean = 10.0 * F.log10(F.greatest("m_", F.lit(1.0)))
    margin = F.when(F.col("mean_") < 0, 10.0).when(F.col("mean_") < 42.43, 10.0 - F.pow("mean_", F.lit(2.0)) / 180.0).otherwise(0.0)
    rows = rows.withColumn("mean_", mean).withColumn("core_", (F.col("z_") >= strong) | ((F.col("z_") - F.col("mean_") >= margin) & (F.col("z_") >= 25)))
    reach = F.floor(F.least(F.greatest(1.0 + (F.col("mean_") - 25.0) / 5.0, F.lit(1.0)), F.lit(5.0))) - 1
    steps = [(a, b) for a in range(-4, 5) for b in range(-4, 5) if abs(a) + abs(b) <= 4]
    grown = rows.where("core_").select(*keys, "j", "i", reach.alias("reach_")).withColumn("o_", _offsets(steps)).where(F.abs("o_.dj") + F.abs("o_.di") <= F.col("reach_"))
    grown = grown.select(*keys, (F.col("j") + F.col("o_.dj")).alias("j"), (F.col("i") + F.col("o_.di")).alias("i"), F.lit(True).alias("near_")).distinct()
    near = rows.select(*df.columns, "z_").join(grown, [*keys, "j", "i"], "left")
    return near.withColumn("convective", F.coalesce("near_", F.lit(False)) & (F.col("z_") >= 15)).select(*df.columns, "convective")


def despeckle(df: DataFrame, keys: Sequence[str], value: str, least_cells: int = 4, strong: float = 30.0, echo: float = 12.0, clutter: str | None = None) -> DataFrame:
    """speck: whether a cell belongs to a connected echo of fewer than least_cells cells whose peak is strong: isolated
    clutter. Four neighbours connect. Cells marked in the boolean column `clutter` are unknown. clean: the value, without
    echo (-32) at specks, null where unknown. A field at one time is one bounded group."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "j", "i", value]) + ", speck boolean, clean double"

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[value].where(~pdf[clutter].astype(bool)) if clutter else pdf[value]
        cells = {(j, i): v for j, i, v in zip(pdf["j"], pdf["i"], known, strict=True) if v is not None and v >= echo}
        speck: set[tuple[int, int]] = set()
        todo = dict(cells)
        while todo:
            stack = [next(iter(todo))]
            todo.pop(stack[0])
            part = []
            while stack:
                j, i = stack.pop()
                part.append((j, i))
                for n in ((j + 1, i), (j - 1, i), (j, i + 1), (j, i - 1)):
                    if n in todo:
                        todo.pop(n)
                        stack.append(n)
            if len(part) < least_cells and max(cells[c] for c in part) >= strong:
                speck.update(part)
        marks = pd.Series([(j, i) in speck for j, i in zip(pdf["j"], pdf["i"], strict=True)], index=pdf.index)
        return pdf[[*keys, "j", "i", value]].assign(speck=marks, clean=known.where(~marks, -32.0))

    return df.groupBy(*keys).applyInPandas(mark, schema)


def centred_difference(df: DataFrame, keys: Sequence[str], value: str, axis: str, spacing: float, out: str) -> DataFrame:
    """Half the difference of the two neighbours along an axis; one-sided at the edges."""
    other = "i" if axis == "j" else "j"
    w = Window.partitionBy(*keys, other).orderBy(axis)
    a, b = F.lag(value).over(w), F.lead(value).over(w)
    d = F.when(a.isNull(), b - F.col(value)).when(b.isNull(), F.col(value) - a).otherwise((b - a) / 2)
    return df.withColumn(out, d / spacing)


def grid(spark: SparkSession, ny: int, nx: int, lat0: float, lon0: float, step: float) -> DataFrame:
    """c, j, i, lat, lon of all cells, by their centres."""
    j, i = F.floor(F.col("id") / nx).cast("int"), (F.col("id") % nx).cast("int")
    return spark.range(ny * nx).select(F.col("id").cast("int").alias("c"), j.alias("j"), i.alias("i"), (lat0 + (j + 0.5) * step).alias("lat"), (lon0 + (i + 0.5) * step).alias("lon"))
