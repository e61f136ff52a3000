"""Products of the warning cycle: catchments, zones, dressed amounts, places along a river, plans of runs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import areal_reduction, clip, dress, duration_threshold, response_time, runoff_depth
from tessera.operators.grids import nearest_points, shifted
from tessera.operators.weighted import step_quantiles
from tessera.sources.storage import durable


def displaced(field: DataFrame, keys: Sequence[str], value: str, dj: int, di: int, ny: int, nx: int, stays: float = 0.4) -> DataFrame:
    """A scenario's field as it is, with the share `stays` of its weight, and moved one step north, south, east and west, with
    an equal part of the rest each: variant, share."""
    moves = [(0, 0, stays), *((a, b, (1 - stays) / 4) for a, b in ((dj, 0), (-dj, 0), (0, di), (0, -di)))]
    parts = [(shifted(field, keys, value, a, b, ny, nx) if a or b else field.select(*keys, "j", "i", value)).withColumns({"variant": F.lit(k), "share": F.lit(s)}) for k, (a, b, s) in enumerate(moves)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass(frozen=True)
class Catchments:
    """durations in hours; gate in mm; runoff threshold and retention in mm; response time a * area ** b, at most `slowest`
    hours; the envelope of unit peaks c * area ** exponent, of which `fraction` is the highest level."""

    durations: tuple[int, ...] = (1, 3, 6, 12)
    gate: float = 10.0
    p0: float = 40.0
    s: float = 200.0
    a: float = 0.3
    b: float = 0.5
    slowest: float = 12.0
    envelope: float = 100.0
    exponent: float = -0.4
    fraction: float = 0.5


def upstream_rain(own: DataFrame, shares: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, u, t and the mean rain over each unit and all upstream of it (measured o, forecast f), of own (keys, u, t, o, f) and
    shares (u, src, w: area weights that sum to 1 for each u)."""
    return own.withColumnRenamed("u", "src").join(shares, "src").groupBy(*keys, "u", "t").agg(F.sum(F.col("w") * F.col("o")).alias("up_o"), F.sum(F.col("w") * F.col("f")).alias("up_f"))


def catchment_ratios(own: DataFrame, shares: DataFrame, units: DataFrame, frames: DataFrame, keys: Sequence[str], s1: float = 1.0, s12: float = 1.0, bias: float = 1.0, c: Catchments = Catchments(), longest: int = 12) -> DataFrame:
    """For each scenario (keys), frame (f, t0, t1] and unit: ratio (array by level) of rain to threshold, the larger of the unit's
    own and that of all upstream of it, over all durations; at the highest level also that of the unit peak discharge to its
    envelope; own12 and up12, the largest 12-hour means; q, the unit peak (m3/s/km2); upstream: whether rain upstream is the
    larger problem at the third level.

    own: keys, u, t, o (measured) and f (forecast) mean rain of each hour, all hours present. units: u, area, up_area, t1, t12
    (arrays of the levels' thresholds). Measured rain counts only so far as more is coming; the family's factors (s1, s12) and
    the bias act on the forecast. Upstream windows may end up to a response time (at most `longest` hours) before the frame."""
    rows = own.join(upstream_rain(own, shares, keys), [*keys, "u", "t"]).join(units, "u")
    by = Window.partitionBy(*keys, "u").orderBy("t")
    roll = lambda x, d: F.sum(x).over(by.rangeBetween(-(d - 1), 0))
    tc = response_time(F.col("up_area"), c.a, c.b, c.slowest)
    rows = rows.withColumns({"lag": F.greatest(F.rint(tc), F.lit(1.0)).cast("int"), "before": F.ceil(tc).cast("int")})
    for d in c.durations:
        rows = rows.withColumns({f"{x}{d}": roll(x, d) for x in ("o", "f", "up_o", "up_f")})
    for d in (12, 24):
        if d not in c.durations:
            rows = rows.withColumns({f"{x}{d}": roll(x, d) for x in ("o", "f", "up_o", "up_f")})

    def ratios(o: str, f: str, area: str) -> Column:
        def at(k: Column) -> Column:
            out = []
            for d in c.durations:
                s = s12 if d >= 6 else s1 if d == 1 else 0.5 * (s1 + s12)
                new = s * F.col(f"{f}{d}")
                limit = duration_threshold(F.get("t1", k), F.get("t12", k), float(d)) * areal_reduction(F.col(area))
                out.append((clip(new / c.gate, 0.0, 1.0) * F.col(f"{o}{d}") + bias * new) / limit)
            return F.greatest(*out) if len(out) > 1 else out[0]

        return F.transform(F.sequence(F.lit(0), F.size("t1") - 1), at)

    wet = F.col("up_o24") + s12 * F.col("up_f24")
    rows = rows.withColumns({"r_own": ratios("o", "f", "area"), "r_up": ratios("up_o", "up_f", "up_area"), "e": runoff_depth(wet, c.p0, c.s), "share_f": s12 * F.col("up_f24") / F.greatest(wet, F.lit(1e-9)), "own12": F.col("o12") + F.col("f12"), "up12": F.col("up_o12") + F.col("up_f12")})
    earlier = rows.select(*keys, "u", (F.col("t") + F.col("lag")).alias("t"), F.col("e").alias("e0"))
    rows = rows.join(earlier, [*keys, "u", "t"], "left")
    q = F.greatest(F.col("e") - F.coalesce("e0", F.lit(0.0)), F.lit(0.0)) / F.col("lag") * 0.278
    full = c.fraction * c.envelope * F.pow(F.greatest("up_area", F.lit(1.0)), F.lit(c.exponent))
    rows = rows.withColumn("q", q).withColumn("r_q", F.col("q") / full * (1 + (bias - 1) * F.col("share_f")))
    # frames are few: each hour goes to those that it may count for
    hours = F.broadcast(frames.select("f", "t0", "t1", F.explode(F.sequence(F.col("t0") + 1 - longest, F.col("t1"))).alias("t")))
    met = rows.drop("f").join(hours, "t").where(F.col("t") > F.col("t0") - F.least("before", F.lit(longest)))
    inside = F.col("t") > F.col("t0")
    levels = range(4)
    tops = [F.max(F.when(inside, F.get("r_own", F.lit(k)))).alias(f"o_{k}") for k in levels] + [F.max(F.greatest(F.get("r_up", F.lit(k)), F.col("r_q")) if k == 3 else F.get("r_up", F.lit(k))).alias(f"u_{k}") for k in levels]
    out = met.groupBy(*keys, "f", "u").agg(*tops, F.max(F.when(inside, F.col("own12"))).alias("own12"), F.max(F.when(inside, F.col("up12"))).alias("up12"), F.max("q").alias("q")).where("own12 is not null")
    return out.select(*keys, "f", "u", F.array(*[F.greatest(f"o_{k}", f"u_{k}") for k in levels]).alias("ratio"), "own12", "up12", "q", (F.col("u_2") > F.col("o_2")).cast("double").alias("upstream"))


def catchment_product(ratios: DataFrame, weight: str, tau: Sequence[float], sigma: float) -> DataFrame:
    """f, u: p2 to p5, the weighted probabilities of the levels (made to fall), level, and the weighted median and 90 % quantile
    of own12, up12 and q, and the share of scenarios in which upstream rain is the larger problem. ratios have their bias."""
    n = len(tau)
    known = ratios.where(F.col(weight) > 0)
    p = [F.sum(F.col(weight) * dress(F.get("ratio", F.lit(k)), sigma)) / F.sum(weight) for k in range(n)]
    base = known.groupBy("f", "u").agg(*[x.alias(f"raw{k}") for k, x in enumerate(p)], (F.sum(F.col(weight) * F.col("upstream")) / F.sum(weight)).alias("upstream"))
    down = [F.least(*[F.col(f"raw{j}") for j in range(k + 1)]) if k else F.col("raw0") for k in range(n)]
    out = base.select("f", "u", "upstream", *[x.alias(f"p{k + 2}") for k, x in enumerate(down)])
    reached = F.greatest(F.lit(1), *[F.when(F.col(f"p{k + 2}") >= t, k + 2).otherwise(1) for k, t in enumerate(tau)])
    out = out.withColumn("level", reached)
    for x in ("own12", "up12", "q"):
        qs = step_quantiles(known, ["f", "u"], x, weight, {f"{x}_50": 0.5, f"{x}_90": 0.9}).drop("mean")
        out = out.join(qs, ["f", "u"])
    return out


def dressed_amounts(amounts: DataFrame, keys: Sequence[str], levels: Column, sigma: float, bias: float, sigma1: float, bias1: float, sigma_seen: float = 0.15, seen_factor: float = 1.0) -> DataFrame:
    """keys, level, p, p1, p12 of members with a1, a12 (scaled by their family), w and seen, the share of a12 that is measured:
    bias and spread act on the rest of it alone. p1 is of the members that know a1, p12 of those that know either; p is made
    to fall with the level."""
    rows = amounts.where("w > 0 and (a1 is not null or a12 is not null)").withColumn("x_", F.explode(levels)).select("*", "x_.*")
    seen = F.coalesce("seen", F.lit(0.0))
    s12 = F.greatest(sigma * (1 - seen), F.lit(min(sigma, sigma_seen)))
    b12 = seen * seen_factor + (1 - seen) * bias
    p1 = F.when(F.col("a1").isNotNull(), dress(F.col("a1") / F.col("t1"), sigma1, bias1)).otherwise(0.0)
    p12 = F.when(F.col("a12").isNotNull(), dress(F.col("a12") / F.col("t12"), s12, b12)).otherwise(0.0)
    rows = rows.withColumns({"p1_": p1, "p12_": p12, "w1_": F.when(F.col("a1").isNotNull(), F.col("w"))})
    raw = rows.groupBy(*keys, "level").agg((F.sum(F.col("w") * F.greatest("p1_", "p12_")) / F.sum("w")).alias("raw"), (F.sum(F.col("w1_") * F.col("p1_")) / F.sum("w1_")).alias("p1"), (F.sum(F.col("w") * F.col("p12_")) / F.sum("w")).alias("p12"))
    fall = Window.partitionBy(*keys).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    return raw.select(*keys, "level", F.min("raw").over(fall).alias("p"), F.coalesce("p1", F.lit(0.0)).alias("p1"), "p12")


def zone_ratios(amounts: DataFrame, keys: Sequence[str], member: str, weight: str, levels: Column) -> DataFrame:
    """keys (zone and frame), member, level, ratio: the largest of a1 / t1 and a12 / t12 over the zone's cells (null members, those
    without any amount there, go), and share, the member's part of the weights of those that remain."""
    rows = amounts.withColumn("x_", F.explode(levels)).select("*", "x_.*")
    ratio = F.greatest(F.max(F.col("a12") / F.col("t12")), F.max(F.col("a1") / F.col("t1")))
    best = rows.groupBy(*keys, member, "level").agg(ratio.alias("ratio"), F.first(weight).alias("w_")).where("ratio is not null")
    return best.withColumn("share", F.col("w_") / F.sum("w_").over(Window.partitionBy(*keys, "level"))).drop("w_")


def zone_truth(observed: DataFrame, keys: Sequence[str], levels: Column) -> DataFrame:
    """keys, level, event: whether any cell reached the level in one hour or in twelve."""
    rows = observed.withColumn("x_", F.explode(levels)).select("*", "x_.*")
    return rows.groupBy(*keys, "level").agg(F.coalesce(F.bool_or((F.col("o1") >= F.col("t1")) | (F.col("o12") >= F.col("t12"))), F.lit(False)).alias("event"))


def first_below(places: DataFrame, chains: DataFrame, points: DataFrame, most_km: float = 12.0) -> DataFrame:
    """The control point of each place (id, unit, lat, lon): the first in a unit down its chain (unit, below, steps), of equals the
    least id; else the nearest within most_km; else none. points: pt, unit, lat, lon. A chain is settled once for each unit (there
    are few units: they are broadcast), and only places without a point on theirs seek the nearest."""
    by_unit = points.groupBy(F.col("unit").alias("below")).agg(F.min("pt").alias("pt"))
    chained = chains.join(by_unit, "below").groupBy("unit").agg(F.min_by("pt", F.struct("steps", "pt")).alias("chained"))  # a row for each unit
    known = durable(places.select("id", "unit", "lat", "lon").join(F.broadcast(chained), "unit", "left"))
    others = points.select(F.col("pt").alias("oid"), F.col("lat").alias("olat"), F.col("lon").alias("olon"))
    nearest = nearest_points(known.where("chained is null").select("id", "lat", "lon"), others, 1, most_km).select("id", F.col("oid").alias("near"))
    return known.join(nearest.hint("merge"), "id", "left").select("id", F.coalesce("chained", "near").alias("pt"), F.when(F.col("chained").isNotNull(), "chain").when(F.col("near").isNotNull(), "near").alias("by"))


def run_of_each_time(times: DataFrame, runs: DataFrame) -> DataFrame:
    """The run that feeds each valid time: of runs (rank, run, t) that have it, the one with the least rank."""
    return times.join(runs, "t").groupBy("t").agg(F.min_by("run", "rank").alias("run"), F.min("rank").alias("rank"))


def mixed_axis(ends: DataFrame, fine: int) -> DataFrame:
    """t: hours every 3 from `lo` (rounded down to 3) to `fine` hours on, then those divisible by 6 until `hi`. ends: rows of lo, hi."""
    first = F.col("lo") - F.pmod("lo", F.lit(3))
    near = ends.select(F.explode(F.sequence(first, first + fine, F.lit(3).cast("long"))).alias("t"))
    change = first + fine - fine % 3 + 1
    return near.unionByName(ends.where(F.col("hi") >= change).select(F.explode(F.sequence(change, F.col("hi"))).alias("t")).where("t % 6 = 0"))


def nested_threshold(df: DataFrame, case: str, p: str, event: str, weight: str, taus: Sequence[float], slack: float = 0.005) -> DataFrame:
    """For each case the greatest threshold whose CSI over all other cases is within `slack` of the best there, and hits, misses
    and false alarms with it on the case itself. Rows are counted by case and by how many thresholds they reach, so no row is
    read twice and the rest is small."""
    cuts = F.array(*[F.lit(float(t)) for t in sorted(taus)])
    reached = F.size(F.filter(cuts, lambda t: t <= F.col(p)))
    counts = df.groupBy(case, reached.alias("k_")).agg(F.sum(F.when(F.col(event), F.col(weight)).otherwise(0.0)).alias("e_"), F.sum(F.when(F.col(event), 0.0).otherwise(F.col(weight))).alias("n_"))
    wide = counts.withColumn("x_", F.explode(F.transform(cuts, lambda t, i: F.struct(t.alias("tau"), (F.col("k_") > i).alias("warned")))))
    own = wide.groupBy(case, "x_.tau").agg(*[F.sum(F.when(c, F.col(v)).otherwise(0.0)).alias(n) for n, c, v in (("hits", F.col("x_.warned"), "e_"), ("misses", ~F.col("x_.warned"), "e_"), ("alarms", F.col("x_.warned"), "n_"))])
    every = Window.partitionBy("tau")
    rest = {n: F.sum(n).over(every) - F.col(n) for n in ("hits", "misses", "alarms")}
    csi = F.coalesce(rest["hits"] / F.nullif(rest["hits"] + rest["misses"] + rest["alarms"], F.lit(0.0)), F.lit(0.0))
    scored = own.withColumn("csi", csi)
    good = scored.withColumn("top_", F.max("csi").over(Window.partitionBy(case))).where(F.col("csi") >= F.col("top_") - slack)
    return good.groupBy(case).agg(F.max_by(F.struct("tau", "hits", "misses", "alarms"), "tau").alias("b")).select(case, "b.*")


def leave_one_out_skill(df: DataFrame, candidate: str, case: str, stratum: str, levels: Sequence[int], sums: str = "sq", least_events: int = 30, least_cases: int = 2) -> DataFrame:
    """For each case the candidate with the best mean Brier skill on the other cases (of equals the least), over the levels that
    are eligible: with at least `least_events` events from at least `least_cases` cases. df has a row for each candidate, case,
    stratum and level: n, events, weight (of the stratum) and sq, the sum of squared errors. Totals less a case's own serve all."""
    w = F.col("weight")
    own = df.groupBy(candidate, case, "level").agg(F.sum(w * F.col("n")).alias("n_"), F.sum(w * F.col("events")).alias("e_"), F.sum(w * F.col(sums)).alias("s_"), F.sum("events").alias("raw_"))
    every = Window.partitionBy(candidate, "level")
    own = own.withColumn("fit_", (F.sum("raw_").over(every) >= least_events) & (F.sum((F.col("raw_") > 0).cast("int")).over(every) >= least_cases) & F.col("level").isin(*levels))
    rest = own.withColumns({c: F.sum(c).over(every) - F.col(c) for c in ("n_", "e_", "s_")})
    base = F.col("e_") / F.col("n_")
    skill = F.when(F.col("fit_") & (base * (1 - base) > 0), 1 - F.col("s_") / F.col("n_") / (base * (1 - base)))
    mean = rest.withColumn("b_", skill).groupBy(case, candidate).agg(F.coalesce(F.avg("b_"), F.lit(-9.0)).alias("bss"))
    return mean.groupBy(case).agg(F.min_by(F.struct(candidate, "bss"), F.struct(-F.round("bss", 9), candidate)).alias("b")).select(case, "b.*")


def jet_streak(field: DataFrame, keys: Sequence[str], lat: float, lon: float, least: float = 30.0, most_km: float = 2500.0, favours_km: float = 1200.0) -> DataFrame:
    """The strongest wind (u, v at lat, lon) within most_km of a place, per key, and, if it has `least` m/s, the quadrant of the
    streak that the place lies in; left exit and right entrance within favours_km favour ascent."""
    rad = math.pi / 180
    dy, dx = F.col("lat") * rad, (F.col("lon") - lon) * rad
    cos = math.sin(lat * rad) * F.sin(dy) + math.cos(lat * rad) * F.cos(dy) * F.cos(dx)
    km = 6371.0 * F.acos(F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0)))
    rows = field.withColumns({"km": km, "speed": F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))}).where(F.col("km") <= most_km)
    best = rows.groupBy(*keys).agg(F.min_by(F.struct("speed", "lat", "lon", "km", "u", "v"), F.struct(-F.col("speed"), "lat", "lon")).alias("b")).select(*keys, "b.*")
    y, x = F.sin((lon - F.col("lon")) * rad) * math.cos(lat * rad), F.cos(dy) * math.sin(lat * rad) - F.sin(dy) * math.cos(lat * rad) * F.cos((lon - F.col("lon")) * rad)
    back = F.atan2(y, x)  # from the core to the place
    east, north = F.col("km") * F.sin(back), F.col("km") * F.cos(back)
    along, left = (east * F.col("u") + north * F.col("v")) / F.col("speed"), (F.col("u") * north - F.col("v") * east) / F.col("speed")
    name = F.concat(F.when(left > 0, "left").otherwise("right"), F.when(along > 0, "-exit").otherwise("-entrance"))
    out = best.withColumn("quadrant", F.when(F.col("speed") >= least, name))
    return out.withColumn("favourable", F.coalesce(F.col("quadrant").isin("left-exit", "right-entrance") & (F.col("km") <= favours_km), F.lit(False)))


def day_ladders(parts: DataFrame, keys: Sequence[str], least: float = 0.6) -> DataFrame:
    """Hourly ladders (keys, hour, rung, excess, coverage) of a day, over their coverage; hours with less than `least` of it go."""
    return parts.where(F.col("coverage") >= least).select(*keys, "hour", "rung", (F.col("excess") / F.col("coverage")).alias("excess"))


def return_period_range(amount: Column, periods: Sequence[float], low: Sequence[Column], high: Sequence[Column]) -> tuple[Column, Column]:
    """The return periods at which the upper and the lower band of the return levels (a column for each period, rising) reach
    an amount, linear in the logarithm of the period: the least period if the amount is below the band, infinity above it."""

    def where(curve: Sequence[Column]) -> Column:
        out = F.when(amount <= curve[0], F.lit(float(periods[0])))
        for a, b, x, y in zip(curve[:-1], curve[1:], periods[:-1], periods[1:], strict=True):
            out = out.when(amount < b, F.exp(math.log(x) + (amount - a) / F.nullif(b - a, F.lit(0.0)) * math.log(y / x)))
        return out.otherwise(F.lit(float("inf")))

    return where(high), where(low)


def flood_cause(ratio: Column, regulated: Column, few_gauges: Column, excess: Column, recovered: Column) -> Column:
    """Why a flood was missed, and whether the vote found it."""
    why = F.when(regulated, "regulated").when(few_gauges, "few gauges").when(ratio >= 0.5, "near miss").when(excess < 1.5, "marginal").otherwise("complete miss")
    return F.concat(why, F.when(recovered, ", recovered").otherwise(""))


def channel_capacity(df: DataFrame) -> DataFrame:
    """id, q, kind: a capacity that was observed stands; else that of the section, if it is plausible (half the two-year flood to
    the envelope), surveyed well and not confined; else the least plausible published one. df: id, area, t2, section, confidence,
    confined, published (array), observed."""
    top = 100.0 * F.pow(F.greatest("area", F.lit(1.0)), F.lit(-0.4)) * F.col("area")
    low = F.coalesce(0.5 * F.col("t2"), F.lit(0.0))
    good = F.col("section").between(low, top) & ~F.col("confidence").eqNullSafe("low") & ~F.coalesce("confined", F.lit(False))
    fits = F.array_min(F.filter("published", lambda x: (x >= low) & (x <= top)))
    section = F.when(good, F.round("section", 1))
    q = F.coalesce("observed", section, fits)
    kind = F.when(F.col("observed").isNotNull(), "observed").when(section.isNotNull(), "section").when(fits.isNotNull(), "published")
    return df.select("id", q.alias("q"), kind.alias("kind"))


def station_facts(stations: DataFrame, places: DataFrame, days: DataFrame, known: DataFrame) -> DataFrame:
    """Peaks of stations (code, inst, inst_day, daily, daily_day) at known places (code, point) on days of cases (day, case): the
    instant maximum, else the daily mean as a lower bound; what is known already (case, point) goes."""
    peak = stations.select("code", F.coalesce("inst", "daily").alias("peak"), F.when(F.col("inst").isNotNull(), F.col("inst_day")).otherwise(F.col("daily_day")).alias("day"), F.col("inst").isNotNull().alias("measured"))
    met = peak.where("peak is not null").join(places, "code").join(days, "day").select("case", "point", "peak", "measured", "day")
    return met.join(known, ["case", "point"], "left_anti")


def in_frames(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """rows (t) with the frames (f, t0, t1] that they fall in. Frames are few, so their hours go to the rows."""
    return rows.join(F.broadcast(frames.select("f", F.explode(F.sequence(F.col("t0") + 1, F.col("t1"))).alias("t"))), "t")


def fallen(rows: DataFrame, keys: Sequence[str], chances: Sequence[Column], weight: str, tau: Sequence[float], extra: Sequence[Column] = ()) -> DataFrame:
    """keys, p2, p3, ...: weighted means of the chances, made to fall with the level; level: the highest that reaches its tau; and
    further aggregates."""
    means = [(F.sum(F.col(weight) * c) / F.sum(weight)).alias(f"raw{k}") for k, c in enumerate(chances)]
    base = rows.where(F.col(weight) > 0).groupBy(*keys).agg(*means, *extra)
    down = [F.least(*[F.col(f"raw{j}") for j in range(k + 1)]) if k else F.col("raw0") for k in range(len(chances))]
    out = base.withColumns({f"p{k + 2}": x for k, x in enumerate(down)}).drop(*[f"raw{k}" for k in range(len(chances))])
    return out.withColumn("level", F.greatest(F.lit(1), *[F.when(F.col(f"p{k + 2}") >= t, k + 2).otherwise(1) for k, t in enumerate(tau)]))


def discharge_product(q: DataFrame, points: DataFrame, frames: DataFrame, weight: str, tau: Sequence[float], sigma: float, vote: str | None = None) -> DataFrame:
    """f, pt: probabilities of the levels, level, and the weighted median and 90 % quantile of the frames' peaks (peak_50, peak_90).
    q: member, pt, t, q (m3/s), the weight, and, if given, vote: a chance that may raise the first two levels and never lowers
    one. points: pt, limits (array of the levels' discharges; null: no level)."""
    votes = [F.max(F.col(vote)).alias("vote_")] if vote else []
    peaks = in_frames(q, frames).groupBy("member", "pt", "f").agg(F.max("q").alias("peak"), F.first(weight).alias(weight), *votes).join(points, "pt")
    chances = [F.coalesce(dress(F.col("peak") / F.get("limits", F.lit(k)), sigma), F.lit(0.0)) for k in range(len(tau))]
    if vote:
        chances = [F.greatest(c, F.coalesce("vote_", F.lit(0.0))) if k < 2 else c for k, c in enumerate(chances)]
    out = fallen(peaks, ["f", "pt"], chances, weight, tau)
    return out.join(step_quantiles(peaks, ["f", "pt"], "peak", weight, {"peak_50": 0.5, "peak_90": 0.9}).drop("mean"), ["f", "pt"])


def reservoir_product(sim: DataFrame, dams: DataFrame, frames: DataFrame, weight: str, tau: Sequence[float]) -> DataFrame:
    """f, dam: probabilities of the levels, level, of being inside the flood reserve (reserve), of spilling (spilling) and of passing
    what the spillway is built for (design), and weighted quantiles of the volume at the frame's end (v10, v50, v90).

    sim: member, dam, t, volume, outflow, spill and the weight. dams: dam, start, full (the spill volume), top, reserve_from,
    able (m3/s of the spillway), gain and rise (hm3 above the start that count for the second level, the latter inside the
    reserve), limits (array of the outflows of levels 2 to 4); unknown ones are null."""
    c = F.col
    rows = in_frames(sim, frames).groupBy("member", "dam", "f").agg(F.max("volume").alias("most"), F.max_by("volume", "t").alias("last"), F.max("outflow").alias("out"), F.max("spill").alias("over"), F.first(weight).alias(weight))
    rows = rows.join(dams, "dam")
    sure = lambda x: F.coalesce(x, F.lit(False))
    inside = sure(c("most") >= c("reserve_from"))
    spilling = (c("over") > 0) | (c("most") >= c("full") * 0.9995)
    design = sure(c("over") >= c("able")) | sure(c("most") >= c("top"))
    beyond = [sure(c("out") >= F.get("limits", F.lit(k))) for k in range(3)]
    second = (c("most") - c("start") >= c("gain")) | (inside & (c("most") - c("start") >= c("rise"))) | beyond[0]
    third, fourth = spilling | beyond[1], beyond[2]
    chance = lambda x: x.cast("double")
    mean = lambda x, n: (F.sum(c(weight) * chance(x)) / F.sum(weight)).alias(n)
    out = fallen(rows, ["f", "dam"], [chance(second | third | fourth | design), chance(third | fourth | design), chance(fourth | design), chance(design)], weight, tau, [mean(inside, "reserve"), mean(spilling, "spilling"), mean(design, "design")])
    return out.join(step_quantiles(rows, ["f", "dam"], "last", weight, {"v10": 0.1, "v50": 0.5, "v90": 0.9}).drop("mean"), ["f", "dam"])


def event_maxima(rain: DataFrame, keys: Sequence[str], start: int, end: int, durations: Sequence[int]) -> DataFrame:
    """For each key and duration: the greatest sum of so many hours that ends within (start, end], and when (the first, if tied).
    rain: keys, t, p; absent hours are dry."""
    near = rain.where(F.col("t").between(start - max(durations) + 1, end))
    w = Window.partitionBy(*keys).orderBy("t")
    rolled = near.select(*keys, "t", *[F.sum("p").over(w.rangeBetween(-(d - 1), 0)).alias(f"p{d}_") for d in durations])
    sums = rolled.select(*keys, "t", F.explode(F.array(*[F.struct(F.lit(d).alias("hours"), F.col(f"p{d}_").alias("amount")) for d in durations])).alias("x"))
    inside = sums.where(F.col("t") > start).select(*keys, "t", "x.*")
    return inside.groupBy(*keys, "hours").agg(F.max("amount").alias("amount"), F.min_by("t", F.struct(-F.col("amount"), "t")).alias("at"))
