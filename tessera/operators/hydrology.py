"""Runoff, routing and storage: recurrences in time."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import runoff_coefficient
from tessera.operators.windows import fading_sum, spine


@dataclass(frozen=True)
class Loss:
    """In mm: runoff threshold p0 and retention s; the share alpha of each cell that runs after p0b mm, with its own
    retention sb; the rate phi, above which rain runs off dry ground; in hours: the memory of the wetness."""

    p0: float = 150.0
    s: float = 150.0
    phi: float | None = 40.0
    memory: float = 72.0
    alpha: float = 0.016
    p0b: float = 10.0
    sb: float = 100.0


def _kinds(df: DataFrame, names: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def net_of(wet: Column, rain: Column, loss: Loss, excess: Column | None = None) -> Column:
    """Net rain of an hour after which the wetness is `wet`: the saturated share at mid-hour wetness; of the rest, rain
    above the rate phi (or `excess`, where it is known: that of the bursts within the hour, no more than the rain); and on
    the share alpha all that its own small store does not hold."""
    middle = wet - rain / 2
    share = runoff_coefficient(middle, loss.p0, loss.s)
    runs = rain * share
    if loss.phi is not None:
        above = F.greatest(rain - loss.phi, F.lit(0.0))
        if excess is not None:
            above = F.when(excess.isNotNull() & ~F.isnan(excess), F.least(excess, rain)).otherwise(above)
        runs = runs + (1 - share) * above
    return (1 - loss.alpha) * runs + loss.alpha * rain * runoff_coefficient(middle, loss.p0b, loss.sb)


def every_hour(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, t and the total of value of each hour from each key's first to its last; absent hours have none."""
    total = df.groupBy(*keys, "t").agg(F.sum(value).cast("double").alias(value))
    return spine(total, keys).join(total, [*keys, "t"], "left").select(*keys, "t", F.coalesce(value, F.lit(0.0)).alias(value))


def net_rain(df: DataFrame, keys: Sequence[str], rain: str, loss: Loss = Loss()) -> DataFrame:
    """Wetness and net rain of each hour from each key's first to its last; absent hours are dry. The wetness is a fading
    sum, so long series are many groups and nothing runs hour by hour."""
    wet = fading_sum(every_hour(df, keys, rain), keys, rain, loss.memory, "wetness")
    return wet.select(*keys, "t", F.col(rain).alias("rain"), "wetness", net_of(F.col("wetness"), F.col(rain), loss).alias("net"))


def convolve(net: DataFrame, areas: DataFrame, cell: str, point: str) -> DataFrame:
    """Discharge in m3/s: the sum over lags of area (point, cell, lag_h, km2) times the net rain that long ago."""
    arriving = areas.join(net, cell).select(point, (F.col("t") + F.col("lag_h")).alias("t"), (F.col("km2") * F.col("net") / 3.6).alias("q_"))
    return arriving.groupBy(point, "t").agg(F.sum("q_").alias("q"))


def linear_store(df: DataFrame, keys: Sequence[str], value: str, hours: float) -> DataFrame:
    """A linear reservoir: each hour it moves 1 - exp(-1 / hours) of the way to its inflow."""
    routed = fading_sum(every_hour(df, keys, value), keys, value, hours, "routed", 1 - math.exp(-1 / hours))
    return routed.select(*keys, "t", "routed")


def fit_level_volume(df: DataFrame, keys: Sequence[str], level: str, volume: str) -> DataFrame:
    """volume = a (level - h0) ** b of each key: a, b, h0, rms (of the volumes), n, clipped (the volume at which the gauge stands
    still while the level rises, or null).

    A centimetre of level counts once, by its median volume; it goes if it is far (15 %, 0.02 at least) from the median of
    itself and four neighbours on either side, where there are nine. Of levels at which three or more have the greatest
    volume over more than 25 cm only the first stays. For each of 110 h0 below the lowest level a line goes through the
    logarithms; of those with 1 <= b <= 6 the one that misses the volumes least is kept. Keys with fewer than four levels, or
    less than 30 cm between them, have no fit."""
    points = df.where((F.col(volume) > 0) & F.col(level).isNotNull()).groupBy(*keys, F.round(level, 2).alias("h")).agg(F.median(volume).alias("v"))
    own, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("h").rowsBetween(-4, 4)
    around = F.sort_array(F.collect_list("v").over(w))  # nine values at most
    n = F.size("a_")
    mid = (F.get("a_", F.floor((n - 1) / 2).cast("int")) + F.get("a_", F.floor(n / 2).cast("int"))) / 2
    points = points.withColumns({"a_": around, "n_": F.count("*").over(own)}).withColumn("m_", mid).where((F.col("n_") < 9) | (F.abs(F.col("v") - F.col("m_")) <= F.greatest(0.15 * F.col("m_"), F.lit(0.02))))
    points = points.withColumns({"n_": F.count("*").over(own), "low_": F.min("h").over(own), "high_": F.max("h").over(own), "top_": F.max("v").over(own)})
    points = points.where("n_ >= 4 and high_ - low_ >= 0.3 - 1e-9")
    flat = F.when(F.col("v") >= F.col("top_") * 0.9995, F.col("h"))
    points = points.withColumns({"flat_": F.count(flat).over(own), "from_": F.min(flat).over(own), "to_": F.max(flat).over(own)})
    stands = (F.col("flat_") >= 3) & (F.col("to_") - F.col("from_") > 0.25)
    points = points.withColumn("clipped", F.when(stands, F.col("top_"))).where(~stands | (F.col("h") <= F.col("from_") + 1e-9)).withColumns({"n": F.count("*").over(own), "span_": F.greatest(F.max("h").over(own) - F.min("h").over(own), F.lit(1.0))})
    numbers = "a double, b double, h0 double, rms double, n long, clipped double"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        h, v, far = pdf["h"].to_numpy(float), pdf["v"].to_numpy(float), 3.2 * (40.0 * pdf["span_"].iloc[0] / 3.2) ** (np.arange(80) / 79.0)
        h0 = pdf["low_"].iloc[0] - np.concatenate([0.05 + np.arange(30) * (2.95 / 29), far])
        x, y = np.log(h - h0[:, None]), np.log(v)
        dx, dy = x - x.mean(axis=1, keepdims=True), y - y.mean()
        b = (dx * dy).sum(axis=1) / (dx * dx).sum(axis=1)
        la = y.mean() - b * x.mean(axis=1)
        with np.errstate(over="ignore"):
            rms = np.sqrt(((np.exp(la[:, None] + b[:, None] * x) - v) ** 2).mean(axis=1))
        fine = np.flatnonzero((b >= 1) & (b <= 6))
        k = fine[np.argmin(rms[fine])] if len(fine) else None
        out = pdf[[*keys, "n", "clipped"]].iloc[: len(fine[:1])]
        return out.assign(a=np.exp(la[k]), b=b[k], h0=h0[k], rms=rms[k]) if k is not None else out.assign(a=0.0, b=0.0, h0=0.0, rms=0.0)

    # a key is a row for each centimetre, whatever its readings; its trials are made and judged in one place
    fits = points.select(*keys, "h", "v", "n", "clipped", "low_", "span_").groupBy(*keys).applyInPandas(fit, f"{_kinds(points, keys)}, {numbers}")
    return fits.select(*keys, "a", "b", "h0", "rms", "n", "clipped")


def discharge(rain: DataFrame, areas: DataFrame, keys: Sequence[str], cell: str, point: str, value: str, loss: Loss = Loss(), hours: float = 6.0) -> DataFrame:
    """keys, point, t, q (m3/s): rain of cells (keys, cell, t, value in mm) made net, sent down by the lags of areas (point, cell, lag_h,
    km2), and held back by a linear store at each point. keys tell members apart.

    Flows that reach a point in one hour are added before the shuffle. Hours without rain count as dry; cells without an
    area, and rows of it without rain, add nothing; rain that is null counts as none."""
    net = net_rain(rain, [*keys, cell], value, loss).where("net > 0").select(*keys, cell, "t", "net")
    arriving = net.join(areas, cell).groupBy(*keys, point, (F.col("t") + F.col("lag_h")).alias("t")).agg(F.sum(F.col("km2") * F.col("net") / 3.6).alias("q"))
    return linear_store(arriving, [*keys, point], "q", hours).withColumnRenamed("routed", "q")


def inflow_scenarios(sim: DataFrame, dams: DataFrame, weight: str, sigma: float, nodes: int = 5) -> DataFrame:
    """member, k, dam, t, q, the weight: each simulated inflow with `nodes` equally likely errors, and with what the measured one
    says of its error now.

    sim: member, dam, t (hours), q, weight; dams: dam, now, seen (measured inflow at now, or null), release, fade (hours). Error k
    multiplies by exp(sigma z), z the middle of the k-th of `nodes` equal parts of a normal law. The difference of seen and the
    multiplied inflow at now (0 where it is not simulated) is added to the hours after it: of a positive one, as much as is being
    released stays, the rest fades with exp(-(h - 1/2) / fade) in the h-th hour. Inflows do not fall below 0. Dams without a
    row, or a null now, have no scenarios; without seen nothing is added."""
    law = NormalDist()
    errors = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.exp(sigma * law.inv_cdf((k + 0.5) / nodes))).alias("x")) for k in range(nodes)]))
    known = dams.where("now is not null").select("dam", "now", "seen", F.coalesce("release", F.lit(0.0)).alias("release"), "fade")
    rows = sim.select("member", "dam", "t", "q", weight).join(known, "dam")
    at = rows.where("t = now").groupBy("member", "dam").agg(F.max("q").alias("now_q"))
    wide = rows.where("t > now").join(at, ["member", "dam"], "left").withColumn("e", errors)
    off = F.when(F.col("seen").isNotNull(), F.col("seen") - F.coalesce("now_q", F.lit(0.0)) * F.col("e.x")).otherwise(0.0)
    stays = F.when(off > 0, F.least(off, F.col("release"))).otherwise(0.0)
    fading = F.exp(-(F.col("t") - F.col("now") - 0.5) / F.col("fade"))
    q = F.greatest(F.col("q") * F.col("e.x") + stays + (off - stays) * fading, F.lit(0.0))
    return wide.select("member", F.col("e.k").alias("k"), "dam", "t", q.alias("q"), (F.col(weight) / nodes).alias(weight))


def theil_sen(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Median slope and the median of what it leaves. All pairs of a key's points: keys are sections of few points."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        i, j = np.triu_indices(len(a), 1)
        ok = a[i] != a[j]
        slope = np.median((b[j] - b[i])[ok] / (a[j] - a[i])[ok]) if ok.any() else np.nan
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "slope": [slope], "intercept": [np.median(b - slope * a)]})

    return df.select(*keys, x, y).groupBy(*keys).applyInPandas(run, f"{_kinds(df, keys)}, slope double, intercept double")
