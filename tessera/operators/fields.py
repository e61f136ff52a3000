"""Operators on whole fields and profiles that need an order or an iteration: merging, lows, tracks, flooding, soundings.

A field at one time is a group of a fixed number of cells; fields go side by side."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.grids import kriging_weights, neighbourhood


def _kinds(df: DataFrame, names: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def _kriged(p: np.ndarray, v: np.ndarray, q: np.ndarray, reach: float, nugget: float, variance: bool = False):
    weights, spread = kriging_weights(p, q, reach, nugget)
    return (weights @ v, spread) if variance else weights @ v


def merge_gauges(radar: DataFrame, gauges: DataFrame, keys: Sequence[str], least: int = 5, reach: float = 24.0, nugget: float = 0.1, usual: float = 1.0) -> DataFrame:
    """Conditional merging in square roots: the radar field (j, i, r) plus the kriged difference of gauges (j, i, g) and
    radar at the gauges. With fewer gauges than `least` the field is scaled by the ratio of sums over pairs with 1 or more on
    both (limited to 0.2 to 5), if there are three, else by the usual factor. Cells that the radar does not see get the
    kriged gauges, if there are `least` of them, with their kriging variance, and else stay unknown. Gauges come checked
    (see grids.gauge_check), and moved to where the radar sees them (see grids.register)."""

    def merge(field: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        out = field[[*keys, "j", "i"]].copy()
        r = np.sqrt(np.maximum(field["r"].to_numpy(float), 0))
        q = field[["j", "i"]].to_numpy(float)
        points = points.dropna(subset=["g"]).groupby(["j", "i"], as_index=False)["g"].mean()
        at = points.merge(field[["j", "i", "r"]], on=["j", "i"], how="left")
        seen = at.dropna(subset=["r"])
        if len(seen) >= least:
            difference = np.sqrt(seen["g"].to_numpy(float)) - np.sqrt(np.maximum(seen["r"].to_numpy(float), 0))
            merged = np.maximum(r + _kriged(seen[["j", "i"]].to_numpy(float), difference, q, reach, nugget), 0) ** 2
        else:
            wet = seen[(seen["g"] >= 1) & (seen["r"] >= 1)]
            merged = r * r * (min(max(wet["g"].sum() / wet["r"].sum(), 0.2), 5.0) if len(wet) >= 3 else usual)
        hole = np.isnan(merged)
        if hole.any() and len(at) >= least:
            root = np.sqrt(np.maximum(at["g"].to_numpy(float), 0))
            guess, spread = _kriged(at[["j", "i"]].to_numpy(float), root, q[hole], reach, nugget, variance=True)
            guess = np.maximum(guess, 0)
            merged[hole] = guess**2 + np.minimum(spread * root.var(), guess**2)
        return out.assign(merged=merged)

    return radar.select(*keys, "j", "i", "r").groupBy(*keys).cogroup(gauges.select(*keys, "j", "i", "g").groupBy(*keys)).applyInPandas(merge, f"{_kinds(radar, [*keys, 'j', 'i'])}, merged double")


def ceiling(field: DataFrame, gauges: DataFrame, keys: Sequence[str], value: str, offsets: Sequence[tuple[int, int]], ny: int, nx: int, factor: float = 3.0, extra: float = 20.0, least: int = 3, heavy: float = 20.0, ratio: float = 2.5) -> DataFrame:
    """No more than factor * the greatest gauge around + extra, where at least `least` gauges are around. gauges: j, i, g and,
    if known, r, what the radar saw there. Around a gauge of at least `heavy` that has over `ratio` times as much as the
    radar (taken as 1 at least), the radar is attenuated and a lower bound: there is no ceiling."""
    seen = gauges if "r" in gauges.columns else gauges.withColumn("r", F.lit(None).cast("double"))
    weak = (F.col("g") >= heavy) & (F.col("g") > ratio * F.greatest("r", F.lit(1.0))) & F.col("r").isNotNull()
    at = seen.groupBy(*keys, "j", "i").agg(F.max("g").alias("g_"), F.count("g").alias("n_"), F.max(weak.cast("int")).alias("weak_"))
    cells = field.select(*keys, "j", "i").join(at, [*keys, "j", "i"], "left")
    whole = F.struct(F.coalesce("weak_", F.lit(0)).alias("weak"), F.coalesce("n_", F.lit(0)).alias("n"), F.col("g_").alias("g"))
    gather = lambda x: F.struct(F.max(x["weak"]).alias("weak"), F.sum(x["n"]).alias("n"), F.max(x["g"]).alias("g"))
    near = neighbourhood(cells.withColumn("x_", whole), keys, "x_", offsets, ny, nx, lambda c: gather(F.col(c)), "near_")
    joined = field.join(near, [*keys, "j", "i"], "left")
    bounded = (F.col("near_.n") >= least) & (F.col("near_.weak") == 0)
    return joined.withColumn(value, F.when(bounded, F.least(value, factor * F.col("near_.g") + extra)).otherwise(F.col(value))).drop("near_")


def closed_lows(df: DataFrame, keys: Sequence[str], value: str, half: int = 2, least: float = 1.0) -> DataFrame:
    """Minima of their (2 half + 1)-wide box, with the depth to which they are closed: how far the surface must rise until
    the low joins a lower one or the edge. Cells are flooded from the lowest up, so each low meets its pass once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = {(int(j), int(i)): float(v) for j, i, v in zip(pdf["j"], pdf["i"], pdf[value], strict=True) if v == v}
        parent: dict[tuple[int, int], tuple[int, int]] = {}
        low: dict[tuple[int, int], tuple[int, int]] = {}
        depth: dict[tuple[int, int], float] = {}

        def root(c: tuple[int, int]) -> tuple[int, int]:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        for c in sorted(z, key=lambda c: (z[c], c)):
            parent[c], low[c] = c, c
            around = [(c[0] + a, c[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
            edge = any(n not in z for n in around)
            for n in around:
                if n in parent:
                    a, b = root(c), root(n)
                    if a != b:
                        keep, lose = (a, b) if (z[low[a]], low[a]) <= (z[low[b]], low[b]) else (b, a)
                        depth.setdefault(low[lose], z[c] - z[low[lose]])
                        parent[lose] = keep
            if edge:
                depth.setdefault(low[root(c)], z[c] - z[low[root(c)]])
        rows = []
        for (j, i), d in depth.items():
            box = [z[n] for a in range(-half, half + 1) for b in range(-half, half + 1) if (n := (j + a, i + b)) in z]
            if d >= least and z[j, i] <= min(box):
                rows.append((j, i, z[j, i], d))
        head = {k: pdf[k].iloc[0] for k in keys}
        out = pd.DataFrame(rows, columns=["j", "i", "low", "depth"])
        return out.assign(**head)[[*keys, "j", "i", "low", "depth"]]

    return df.groupBy(*keys).applyInPandas(run, f"{_kinds(df, keys)}, j int, i int, low double, depth double")


def link_tracks(df: DataFrame, keys: Sequence[str], reach: float, most_gap: int) -> DataFrame:
    """Numbers of the tracks of points (t, y, x): each step's points continue the nearest tracks within reach whose last
    point is at most most_gap old, the nearest pair first and each track once; others begin tracks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        last: dict[int, tuple[int, float, float]] = {}
        track = np.zeros(len(pdf), np.int64)
        pdf = pdf.sort_values(["t", "y", "x"]).reset_index(drop=True)
        nxt = 0
        for t, own in pdf.groupby("t"):
            pairs = sorted((float(np.hypot(r.y - y, r.x - x)), k, r.Index) for r in own.itertuples() for k, (u, y, x) in last.items() if t - u <= most_gap)
            used: set[int] = set()
            done: dict[int, int] = {}
            for d, k, r in pairs:
                if d <= reach and k not in used and r not in done:
                    used.add(k)
                    done[r] = k
            for r in own.itertuples():
                k = done.get(r.Index)
                if k is None:
                    k, nxt = nxt, nxt + 1
                track[r.Index], last[k] = k, (t, r.y, r.x)
        return pdf.assign(track=track)

    cols = [*keys, "t", "y", "x"]
    return df.select(*cols).groupBy(*keys).applyInPandas(run, f"{_kinds(df, cols)}, track long")


def fill_depressions(df: DataFrame, keys: Sequence[str], height: str, rise: float = 1e-3) -> DataFrame:
    """Heights raised so that each cell has a way down to the edge that falls by at least `rise` a step, from the edge
    inwards in order of height."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = {(int(j), int(i)): float(v) for j, i, v in zip(pdf["j"], pdf["i"], pdf[height], strict=True)}
        around = lambda c: [(c[0] + a, c[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
        filled: dict[tuple[int, int], float] = {}
        heap = [(v, c) for c, v in z.items() if any(n not in z for n in around(c))]
        queued = {c for _, c in heap}
        heapq.heapify(heap)
        while heap:
            v, c = heapq.heappop(heap)
            filled[c] = v
            for n in around(c):
                if n in z and n not in queued:
                    queued.add(n)
                    heapq.heappush(heap, (max(z[n], v + rise), n))
        return pdf.assign(filled=[filled[int(j), int(i)] for j, i in zip(pdf["j"], pdf["i"], strict=True)])[[*keys, "j", "i", height, "filled"]]

    cols = [*keys, "j", "i", height]
    return df.select(*cols).groupBy(*keys).applyInPandas(run, f"{_kinds(df, cols)}, filled double")


def monotone_profile(df: DataFrame, keys: Sequence[str], order: str, height: str) -> DataFrame:
    """Heights along a way down that never rise: the least so far."""
    return df.withColumn("carved", F.min(height).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def column_integral(df: DataFrame, keys: Sequence[str], pressure: str, value: str, out: str, scale: float = 1.0) -> DataFrame:
    """Trapezoids of a value over pressure, from level to level: with specific humidity, hPa and 100 / 9.80665 it is
    precipitable water in mm."""
    w = Window.partitionBy(*keys).orderBy(pressure)
    part = (F.col(value) + F.lead(value).over(w)) / 2 * (F.lead(pressure).over(w) - F.col(pressure))
    return df.withColumn("part_", part).groupBy(*keys).agg((F.sum("part_") * scale).alias(out))


def at_pressure(df: DataFrame, keys: Sequence[str], pressure: str, value: str, targets: Sequence[float]) -> DataFrame:
    """Values at given pressures, linear in the logarithm; null outside the profile."""
    w = Window.partitionBy(*keys).orderBy(pressure)
    seg = df.select(*keys, F.col(pressure).alias("p0_"), F.lead(pressure).over(w).alias("p1_"), F.col(value).alias("v0_"), F.lead(value).over(w).alias("v1_"))
    wide = seg.withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    inside = (F.col("target") >= F.col("p0_")) & ((F.col("target") < F.col("p1_")) | (F.col("p1_").isNull() & (F.col("target") == F.col("p0_"))))
    part = F.coalesce(F.col("v0_") + (F.col("v1_") - F.col("v0_")) * F.log(F.col("target") / F.col("p0_")) / F.log(F.col("p1_") / F.col("p0_")), F.col("v0_"))
    return wide.groupBy(*keys, "target").agg(F.max(F.when(inside, part)).alias(value))


def parcel_indices(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """CAPE, CIN (J/kg) and the pressure of the lifting condensation level for the lowest level's parcel. df: p (hPa),
    temp and dewpoint (deg C). Dry to saturation, then moist by small steps of pressure; columns are lifted one by one,
    each of some tens of levels."""

    def vapour(t: np.ndarray | float) -> np.ndarray | float:
        return 6.112 * np.exp(17.67 * t / (t + 243.5))

    def ratio(e, p):
        return 0.622 * e / np.maximum(p - e, 1e-6)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.dropna(subset=["p", "temp", "dewpoint"]).sort_values("p", ascending=False)
        head = {k: [pdf[k].iloc[0]] for k in keys}
        if len(d) < 2:
            return pd.DataFrame({**head, "cape": [np.nan], "cin": [np.nan], "lcl": [np.nan]})
        p, t, td = d["p"].to_numpy(float), d["temp"].to_numpy(float), d["dewpoint"].to_numpy(float)
        r0 = ratio(vapour(td[0]), p[0])
        axis = np.arange(p[0], p[-1], -5.0)
        parcel, tk, lcl = [], t[0] + 273.15, np.nan
        for k, q in enumerate(axis):
            dry = (t[0] + 273.15) * (q / p[0]) ** 0.2857
            if np.isnan(lcl):
                tk = dry
                if ratio(vapour(dry - 273.15), q) <= r0:
                    lcl = q
            elif k:
                rs = ratio(vapour(tk - 273.15), q)
                lapse = (287.0 * tk + 2.501e6 * rs) / (1004.0 + 2.501e6**2 * rs * 0.622 / (287.0 * tk * tk)) / q
                tk -= lapse * (axis[k - 1] - q)
            parcel.append(tk)
        env = np.interp(np.log(axis), np.log(p[::-1]), t[::-1]) + 273.15
        work = 287.0 * (np.array(parcel) - env) * np.append(np.log(axis[:-1] / axis[1:]), 0)
        rising = np.flatnonzero(work > 0)
        first = rising[axis[rising] <= (lcl if lcl == lcl else -1)]
        cin = work[: first[0]][work[: first[0]] < 0].sum() if len(first) else 0.0
        cape = work[first[0] :][work[first[0] :] > 0].sum() if len(first) else 0.0
        return pd.DataFrame({**head, "cape": [float(cape)], "cin": [float(cin)], "lcl": [float(lcl)]})

    return df.select(*keys, "p", "temp", "dewpoint").groupBy(*keys).applyInPandas(run, f"{_kinds(df, keys)}, cape double, cin double, lcl double")


def advect(df: DataFrame, keys: Sequence[str], value: str, dj: float, di: float, ny: int, nx: int) -> DataFrame:
    """The field one step on, moved by (dj, di) cells: each cell takes what was upstream of it, bilinearly; beyond the
    edge nothing is known."""
    y, x = F.col("j") - dj, F.col("i") - di
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    cells = df.select(*keys, "j", "i").withColumn("y_", y).withColumn("x_", x).where((F.col("y_") >= 0) & (F.col("y_") <= ny - 1) & (F.col("x_") >= 0) & (F.col("x_") <= nx - 1)).withColumn("o_", corner)
    fy, fx = F.col("y_") - F.floor("y_"), F.col("x_") - F.floor("x_")
    w = F.when(F.col("o_.a") == 1, fy).otherwise(1 - fy) * F.when(F.col("o_.b") == 1, fx).otherwise(1 - fx)
    cells = cells.withColumn("w_", w).where("w_ > 0").withColumn("sj", (F.floor("y_") + F.col("o_.a")).cast("int")).withColumn("si", (F.floor("x_") + F.col("o_.b")).cast("int"))
    source = df.select(*keys, F.col("j").alias("sj"), F.col("i").alias("si"), F.col(value))
    return cells.join(source, [*keys, "sj", "si"]).groupBy(*keys, "j", "i").agg(F.sum(F.col("w_") * F.col(value)).alias(value))


def blend_members(nowcast: DataFrame, donors: DataFrame, n_donors: int, weight, value: str, on: Sequence[str]) -> DataFrame:
    """Members of a nowcast (member) go over into donors (donor, from 0), dealt in turn: weight * own + (1 - weight) * donor;
    where one is missing the other stands."""
    d = donors.withColumnRenamed(value, "d_")
    rows = nowcast.withColumn("donor", F.col("member") % n_donors).join(d, ["donor", *on], "full").where("member is not null")
    return rows.select("member", *on, F.coalesce(weight * F.col(value) + (1 - weight) * F.col("d_"), F.col(value), F.col("d_")).alias(value))
