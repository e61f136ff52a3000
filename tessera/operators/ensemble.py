"""From weighted scenarios to probabilities and warning levels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import dress, logistic, unit_envelope

LEVELS = (2, 3, 4, 5)


def levels_of(thresholds: dict[int, tuple[float, float]]) -> Column:
    """Array of struct(level, t1, t12)."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.lit(float(a)).alias("t1"), F.lit(float(b)).alias("t12")) for k, (a, b) in thresholds.items()])


def default_thresholds(t1: Sequence[float] = (20.0, 40.0, 90.0), t12: Sequence[float] = (60.0, 100.0, 180.0)) -> dict[int, tuple[float, float]]:
    """Three given levels, and a fifth at 3/2 and 5/3 of the highest."""
    return {**{k + 2: (a, b) for k, (a, b) in enumerate(zip(t1, t12, strict=True))}, 5: (t1[-1] * 1.5, t12[-1] * 5 / 3)}


def probabilities(amounts: DataFrame, keys: Sequence[str], thresholds: dict[int, tuple[float, float]], sigma: float, bias: float = 1.0, sigma1: float | None = None, bias1: float | None = None) -> DataFrame:
    """Per key and level the weighted mean over members of the larger of both dressed ratios (a1 over t1, a12 over t12),
    made to fall with the level. Members without an amount weigh nothing; p1 is of the members that know a1 alone."""
    rows = amounts.withColumn("x_", F.explode(levels_of(thresholds))).select("*", "x_.*")
    p1 = dress(F.col("a1") / F.col("t1"), sigma1 or sigma, bias1 or bias)
    p12 = dress(F.col("a12") / F.col("t12"), sigma, bias)
    known = F.col("a1").isNotNull() | F.col("a12").isNotNull()
    both = F.greatest(p1, p12)
    weight = F.when(known, F.col("w"))
    w1 = F.when(F.col("a1").isNotNull(), F.col("w"))
    raw = rows.groupBy(*keys, "level").agg(
        (F.sum(weight * both) / F.nullif(F.sum(weight), F.lit(0.0))).alias("raw"), (F.sum(w1 * p1) / F.nullif(F.sum(w1), F.lit(0.0))).alias("raw1")
    )
    down = Window.partitionBy(*keys).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    return raw.select(*keys, "level", F.min("raw").over(down).alias("p"), F.min("raw1").over(down).alias("p1"))


def decide(df: DataFrame, keys: Sequence[str], tau: dict[int, float], cap: int = 5) -> DataFrame:
    """The highest level whose probability reaches its threshold, else 1, and no more than the cap. A lower level need
    not be reached."""
    need = F.element_at(F.create_map(*[x for k, t in tau.items() for x in (F.lit(k), F.lit(float(t)))]), F.col("level"))
    return df.groupBy(*keys).agg(F.least(F.coalesce(F.max(F.when(F.col("p") >= need, F.col("level"))), F.lit(1)), F.lit(cap)).alias("decided"), F.max("p").alias("p_top"))


def apply_overrides(level: Column, valid: Column, agreement: Column | None = None, vote: Column | None = None) -> Column:
    """Raised by agreement or a vote, then 0 where nothing is valid."""
    raised = F.greatest(*[x for x in (level, agreement, vote) if x is not None]) if agreement is not None or vote is not None else level
    return F.when(valid, raised).otherwise(0)


def agreement(df: DataFrame, keys: Sequence[str], model: str, level: str, weight: str, ensemble: Column, least: int = 2, share: float = 0.3) -> DataFrame:
    """Per key the highest of the levels 4 and 5 that at least `least` models reach; a model votes if any of its members
    reaches it, an ensemble if members with `share` of its weight do."""
    rows = df.withColumn("is_", ensemble)
    votes = []
    for k in (4, 5):
        hit = F.sum(F.when(F.col(level) >= k, F.col(weight)).otherwise(0.0))
        votes.append(F.when(F.bool_or("is_"), hit >= share * F.sum(weight)).otherwise(hit > 0).cast("int").alias(f"v{k}"))
    by_model = rows.groupBy(*keys, model).agg(*votes)
    return by_model.groupBy(*keys).agg(F.when(F.sum("v5") >= least, 5).when(F.sum("v4") >= least, 4).otherwise(0).alias("agreed"))


def observed_gate(df: DataFrame, keys: Sequence[str], value: str, observed: str, gate: float, share: float = 1.0) -> DataFrame:
    """Trailing 12-step amounts whose measured part counts only so far as more rain is coming: seen * clip(share * new /
    gate, 0, 1) + new."""
    w = Window.partitionBy(*keys).orderBy("t").rangeBetween(-11, 0)
    seen, new = F.coalesce(F.sum(F.when(F.col(observed), F.col(value))).over(w), F.lit(0.0)), F.coalesce(F.sum(F.when(~F.col(observed), F.col(value))).over(w), F.lit(0.0))
    part = F.least(F.greatest(share * new / gate, F.lit(0.0)), F.lit(1.0))
    return df.withColumn("a12", seen * part + new).withColumn("phi", F.when(seen * part + new > 0, seen * part / (seen * part + new)).otherwise(0.0))


def spread_to_members(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """p10, p50 and p90 across members, unweighted."""
    return df.groupBy(*keys).agg(*[F.percentile(value, F.lit(q)).alias(n) for n, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))])


def zone_day(features: dict[str, Column], coefficients: dict[str, tuple[float, float, float]], intercept: float) -> Column:
    """Logistic on standardised features: {name: (coefficient, mean, scale)}."""
    z = F.lit(intercept)
    for name, (beta, mean, scale) in coefficients.items():
        z = z + beta * (features[name] - mean) / scale
    return logistic(z)


def overlay_zones(cells: DataFrame, zones: DataFrame, zone: str, keys: Sequence[str], value: str) -> DataFrame:
    """Values of zones replace those of their cells; cells outside keep theirs."""
    z = zones.select(zone, *keys, F.col(value).alias("z_"))
    return cells.join(z, [zone, *keys], "left").withColumn(value, F.coalesce("z_", value)).drop("z_")


def _shares(members: DataFrame, climate: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, p, q and f, the share of members at or below q, of climate (keys, p, q). Equal members are counted, and these counts
    summed by the first quantile that they do not exceed, so no group is ever gathered. What a task holds of the join are the
    levels of its keys; members pass by unsorted."""
    levels = climate.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("p", "q"))).alias("c_"))  # as many as climate has levels
    place = F.size(F.filter("c_", lambda c: c["q"] < F.col(value)))
    same = members.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("m_"))
    counted = same.join(levels.hint("shuffle_hash"), list(keys)).groupBy(*keys, place.alias("k_")).agg(F.sum("m_").alias("n_"))
    hist = counted.groupBy(*keys).agg(F.collect_list(F.struct("k_", "n_")).alias("h_"), F.sum("n_").alias("all_"))
    rows = levels.join(hist, list(keys)).select(*keys, F.posexplode("c_").alias("at_", "c_"), "h_", "all_")
    below = F.aggregate(F.filter("h_", lambda h: h["k_"] <= F.col("at_")), F.lit(0).cast("long"), lambda n, h: n + h["n_"])
    return rows.select(*keys, "c_.p", "c_.q", (below / F.col("all_")).alias("f"))


def forecast_index(members: DataFrame, climate: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Extreme forecast index: 2/pi times the integral of (p - f(p)) / sqrt(p (1 - p)) by trapezoids in p, f being the share
    of members at or below the climate's quantile q_p. climate: keys, p (0 < p < 1), q."""
    rows = _shares(members, climate, keys, value).withColumn("y_", (F.col("p") - F.col("f")) / F.sqrt(F.col("p") * (1 - F.col("p"))))
    w = Window.partitionBy(*keys).orderBy("p")
    parts = rows.withColumn("part_", (F.col("y_") + F.lead("y_").over(w)) / 2 * (F.lead("p").over(w) - F.col("p")) * 2 / math.pi)
    return parts.groupBy(*keys).agg(F.least(F.greatest(F.sum("part_"), F.lit(-1.0)), F.lit(1.0)).alias("efi"))


def closed_forecast_index(members: DataFrame, climate: DataFrame, keys: Sequence[str], value: str, wet: float = 1.0) -> DataFrame:
    """The index in closed form, f linear between levels, which are closed by 0 (f as at the first level) and 1 (the highest
    quantile). With wet > 0 only intervals whose upper quantile exceeds it count, over what all members above would give
    there; null where the climate is dry at all levels."""
    rows = _shares(members, climate, keys, value)
    ends = rows.groupBy(*keys).agg(F.min_by(F.struct("q", "f"), "p").alias("a_"), F.max_by(F.struct("q", "f"), "p").alias("b_"))
    closed = rows.unionByName(ends.select(*keys, F.lit(0.0).alias("p"), "a_.*")).unionByName(ends.select(*keys, F.lit(1.0).alias("p"), "b_.*"))
    w = Window.partitionBy(*keys).orderBy("p")
    angle, root = F.asin(F.sqrt("p")), F.sqrt(F.col("p") * (1 - F.col("p")))
    rows = closed.withColumns({"x_": angle, "r_": root}).withColumns({f"{c}2_": F.lead(c).over(w) for c in ("p", "q", "f", "x_", "r_")}).where("p2_ is not null")
    dx, dr = F.col("x_2_") - F.col("x_"), F.col("r_2_") - F.col("r_")
    slope = (F.col("f2_") - F.col("f")) / (F.col("p2_") - F.col("p"))
    gain = (1 - 2 * F.col("f")) * dx - dr + slope * ((2 * F.col("p") - 1) * dx + dr)
    counts = F.col("q2_") > wet if wet > 0 else F.lit(True)
    sums = rows.groupBy(*keys).agg(F.sum(F.when(counts, gain)).alias("g_"), F.sum(F.when(counts, dx - dr)).alias("m_"))
    return sums.select(*keys, F.when(F.col("m_") > 1e-9, F.least(F.greatest(F.col("g_") / F.col("m_"), F.lit(-1.0)), F.lit(1.0))).alias("efi"))


def shift_of_tails(members: DataFrame, climate: DataFrame, keys: Sequence[str], value: str, p: float = 0.9, floor: float = 0.5) -> DataFrame:
    """(Q_p of members - c_top) / (c_top - c_p), climate with c_p and c_top; a tail shorter than floor counts as that long."""
    q = members.groupBy(*keys).agg(F.percentile(value, F.lit(p)).alias("q_"))
    return q.join(climate, list(keys)).select(*keys, ((F.col("q_") - F.col("c_top")) / F.greatest(F.col("c_top") - F.col("c_p"), F.lit(floor))).alias("sot"))


def worst(df: DataFrame, keys: Sequence[str], level: str, p: str, frame: str) -> DataFrame:
    """Highest level of each key, its frame (of equals the likeliest, then the earliest) and its probability."""
    best = F.min_by(F.struct(frame, level, p), F.struct(-F.col(level), -F.col(p), F.col(frame)))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def flood_vote(peak: Column, potential: Column, threshold: Column, area: Column, depth: Column, beta: Sequence[float]) -> Column:
    """Chance that a threshold (m3/s) is reached, from the simulated peak, the potential flow (both m3/s), the catchment's area
    (km2) and the rain that arrives (mm): logistic in logarithms of ratios, to which a tenth of the envelope of a catchment of
    that size is added. Without a threshold there is none."""
    few = 0.1 * unit_envelope(F.greatest(area, F.lit(1.0)))
    z = beta[0] + beta[1] * F.log((peak + few) / threshold) + beta[2] * F.log((potential + few) / threshold) + beta[3] * F.log1p(depth)
    return F.when(threshold > 0, logistic(z)).otherwise(0.0)
