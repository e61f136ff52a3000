"""Time-series operators: resampling, trailing sums, frames, runs, episodes, filters."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.storage import durable


def _by(keys: Sequence[str], *order: str | Column) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def step_end(ts: Column, seconds: int = 3600) -> Column:
    """Number of the step that a moment belongs to, counted by step ends: right-closed, unlike window()."""
    return F.ceil(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000)).cast("long")


def resample(df: DataFrame, keys: Sequence[str], ts: str, value: str, seconds: int = 3600) -> DataFrame:
    """Per step: n, total, mean, top, and last (the value at the latest moment)."""
    return df.groupBy(*keys, step_end(F.col(ts), seconds).alias("t")).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("top"), F.max_by(value, ts).alias("last")
    )


def complete_steps(df: DataFrame, keys: Sequence[str], ts: str, value: str, expected: int, least: int, seconds: int = 3600) -> DataFrame:
    """Steps with at least `least` of `expected` samples, their totals scaled to all of them."""
    out = resample(df, keys, ts, value, seconds).where(F.col("n") >= least)
    return out.select(*keys, "t", "n", (F.col("total") * expected / F.col("n")).alias("total"))


def trailing(df: DataFrame, keys: Sequence[str], value: str, steps: int, out: str, strict: bool = False, least: int = 1) -> DataFrame:
    """Sum over the `steps` steps that end at each row. strict: null until a whole window has passed since the key's first
    row. least: null if fewer values are present."""
    w = _by(keys, "t").rangeBetween(-(steps - 1), 0)
    total = F.when(F.count(value).over(w) >= least, F.sum(value).over(w))
    if strict:
        total = F.when(F.col("t") - F.min("t").over(Window.partitionBy(*keys)) >= steps - 1, total)
    return df.withColumn(out, total)


def spine(df: DataFrame, keys: Sequence[str], extra: int = 0) -> DataFrame:
    """One row for each key and step from its first to its last (and `extra` more)."""
    ends = df.groupBy(*keys).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return ends.select(*keys, F.explode(F.sequence("a", F.col("b") + extra)).alias("t"))


def frames(spark: SparkSession, start: int) -> DataFrame:
    """The frames (t0, t1] of the three horizons from the step `start`: 6 of 1 hour; 14 of 3 hours from 6 hours on,
    rounded down to 3; days 2 to 7."""
    mid, day = (start + 6) // 3 * 3, start // 24 * 24
    rows = [("now", f, start + f, start + f + 1) for f in range(6)]
    rows += [("mid", f, mid + 3 * f, mid + 3 * f + 3) for f in range(14)]
    rows += [("long", f, day + 24 * (f + 2), day + 24 * (f + 3)) for f in range(6)]
    return spark.createDataFrame(rows, "horizon string, f int, t0 long, t1 long")


def frame_amounts(df: DataFrame, keys: Sequence[str], frame: DataFrame, value: str, share: float = 0.75) -> DataFrame:
    """For each key and frame: a1, the largest step; a12, the largest trailing 12-step sum that ends in the frame (it may
    begin before it; absent steps are dry); n, the steps present. Frames with fewer than max(1, int(share * length)) go.

    Frames are bounded in number and are exploded to their steps, so the join is on equality."""
    steps = frame.withColumn("t", F.explode(F.sequence(F.col("t0") + 1, F.col("t1"))))
    rolled = trailing(df, keys, value, 12, "a12")
    need = F.greatest(F.lit(1), F.floor(share * (F.col("t1") - F.col("t0"))))
    out = rolled.join(F.broadcast(steps), "t").groupBy(*keys, "horizon", "f", "t0", "t1").agg(F.max(value).alias("a1"), F.max("a12").alias("a12"), F.count(value).alias("n"))
    return out.where(F.col("n") >= need)


def spread_accumulations(df: DataFrame, keys: Sequence[str], value: str, since_start: bool, most: int = 6) -> DataFrame:
    """Accumulations at uneven steps to even hours. since_start: totals since the start of the run, of which rising
    differences count; otherwise each covers the time since the row before it (the first: one step)."""
    w = _by(keys, "t")
    gap = F.least(F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(1)), F.lit(most)).cast("int")
    amount = F.greatest(F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0.0)), F.lit(0.0)) if since_start else F.col(value)
    rows = df.select(*keys, "t", gap.alias("gap"), amount.alias("amount")).where(F.col("amount").isNotNull())
    return rows.select(*keys, "gap", (F.col("amount") / F.col("gap")).alias(value), F.explode(F.sequence(F.col("t") - F.col("gap") + 1, F.col("t"))).alias("t"))


def finest_part(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows before the first lengthening of the step between them."""
    w = _by(keys, "t")
    rows = df.withColumn("step_", F.col("t") - F.lag("t").over(w))
    flagged = rows.withColumn("least_", F.min("step_").over(w)).withColumn("longer_", (F.col("step_") > F.col("least_")).cast("int"))
    return flagged.withColumn("seen_", F.coalesce(F.max("longer_").over(w), F.lit(0))).where("seen_ = 0").select(df.columns)


def lagged_difference(df: DataFrame, keys: Sequence[str], value: str, lag: str, out: str) -> DataFrame:
    """value at t less value at t - lag, the lag being a column: a self-join, as lag() takes no column."""
    before = df.select(*keys, (F.col("t") + F.col(lag)).alias("t"), F.col(value).alias("before_"))
    return df.join(before, [*keys, "t"], "left").withColumn(out, F.col(value) - F.coalesce("before_", F.lit(0.0))).drop("before_")


def trapezoid(df: DataFrame, keys: Sequence[str], rate: str, most_gap: float, seconds: float = 3600.0) -> DataFrame:
    """Integral of a rate between samples at `t` (in seconds) no further apart than most_gap, per key: amount, covered
    (seconds that count), of (first to last sample)."""
    w = _by(keys, "t")
    nxt, to = F.lead(rate).over(w), F.lead("t").over(w)
    dt = F.when(to - F.col("t") <= most_gap, to - F.col("t"))
    # a sample whose neighbour is unknown stands for the step alone
    mean = F.coalesce((F.col(rate) + nxt) / 2, F.col(rate), nxt)
    parts = df.select(*keys, "t", mean.alias("m_"), dt.alias("d_"))
    return parts.groupBy(*keys).agg(F.sum(F.col("m_") * F.col("d_") / seconds).alias("amount"), F.sum(F.when(F.col("m_").isNotNull(), F.col("d_"))).alias("covered"), (F.max("t") - F.min("t")).alias("of"))


def ladder_excess(df: DataFrame, keys: Sequence[str], rate: str, rungs: Sequence[float], step_h: float) -> DataFrame:
    """For each rung u, the integral of the rate above it."""
    sums = [F.sum(F.greatest(F.col(rate) - u, F.lit(0.0)) * step_h) for u in rungs]
    stacked = df.groupBy(*keys).agg(F.array(*[F.struct(F.lit(float(u)).alias("rung"), s.alias("excess")) for u, s in zip(rungs, sums, strict=True)]).alias("x"))
    return stacked.select(*keys, F.explode("x").alias("x")).select(*keys, "x.rung", "x.excess")


def telescoped(df: DataFrame, keys: Sequence[str], group: Sequence[str], value: str) -> DataFrame:
    """Newest first: cumulative sums of each key, their maximum in each group of keys, and that maximum's increments."""
    total = F.sum(value).over(Window.partitionBy(*keys).orderBy(F.desc("t")))
    tops = df.withColumn("c_", total).groupBy(*group, "t").agg(F.max("c_").alias("top"))
    w = Window.partitionBy(*group).orderBy(F.desc("t"))
    return tops.withColumn("increment", F.col("top") - F.coalesce(F.lag("top").over(w), F.lit(0.0)))


def rate_of_change(df: DataFrame, keys: Sequence[str], value: str, back: int, least: int) -> DataFrame:
    """For each key: change per step from the last value at or before (newest - back) to the newest; null if the two are
    less than `least` apart. The newest time comes from an aggregate, so no key's rows meet in a window."""
    last = df.groupBy(*keys).agg(F.max("t").alias("t1"), F.max_by(value, "t").alias("v1"))
    old = df.join(last, list(keys)).where(F.col("t") <= F.col("t1") - back).groupBy(*keys).agg(F.max("t").alias("t0"), F.max_by(value, "t").alias("v0"))
    return last.join(old, list(keys), "left").withColumn("rate", F.when(F.col("t1") - F.col("t0") >= least, (F.col("v1") - F.col("v0")) / (F.col("t1") - F.col("t0"))))


def median3(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Running median of a row and its neighbours, as a sum less extremes: no sort for each row. The first and the last
    row, which lack a neighbour, stay as they are."""
    w = _by(keys, "t")
    a, b, c = F.lag(value).over(w), F.col(value), F.lead(value).over(w)
    middle = a + b + c - F.greatest(a, b, c) - F.least(a, b, c)
    return df.withColumn(out, F.when(a.isNull() | c.isNull(), b).otherwise(middle))


def moving_mean(df: DataFrame, keys: Sequence[str], value: str, half: int, out: str) -> DataFrame:
    return df.withColumn(out, F.avg(value).over(_by(keys, "t").rowsBetween(-half, half)))


def events(df: DataFrame, keys: Sequence[str], wet: Column, value: str, gap: int | Column, least_total: float = 0.0) -> DataFrame:
    """Wet steps joined while no more than `gap` apart: event (from 0), t0, t1, steps, total, peak, t_peak."""
    rows = df.where(wet)
    w = _by(keys, "t")
    new = (F.col("t") - F.lag("t").over(w) > gap).cast("int")
    rows = rows.withColumn("event", F.coalesce(F.sum(F.coalesce(new, F.lit(0))).over(w), F.lit(0)))
    out = rows.groupBy(*keys, "event").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("steps"), F.sum(value).alias("total"), F.max(value).alias("peak"), F.min_by("t", F.struct(-F.col(value), "t")).alias("t_peak"))
    return out.where(F.col("total") >= least_total)


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, slack: int = 0) -> DataFrame:
    """Number of the episode that each interval falls in, of overlapping or, within slack, near ones."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(start) > reach + slack, 1).otherwise(0)
    return df.withColumn("new_", new).withColumn("episode", F.sum("new_").over(w)).drop("new_")


def level_runs(df: DataFrame, keys: Sequence[str], level: str) -> DataFrame:
    """Unbroken runs of one level on consecutive steps: level, t0, t1, steps."""
    island = F.col("t") - F.row_number().over(Window.partitionBy(*keys, level).orderBy("t"))
    return df.withColumn("i_", island).groupBy(*keys, level, "i_").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("steps")).drop("i_")


def first_crossing(df: DataFrame, keys: Sequence[str], value: str, thresholds: Sequence[float]) -> DataFrame:
    """First step at which each threshold is reached, or null."""
    return df.groupBy(*keys).agg(*[F.min(F.when(F.col(value) >= x, F.col("t"))).alias(f"t_{k}") for k, x in enumerate(thresholds)])


def yearly_maxima(df: DataFrame, keys: Sequence[str], year: Column, value: str) -> DataFrame:
    return df.groupBy(*keys, year.alias("year")).agg(F.max(value).alias("top"), F.min_by("t", F.struct(-F.col(value), "t")).alias("t_top"), F.count(value).alias("n"))


def best_lag(a: DataFrame, b: DataFrame, keys: Sequence[str], lags: Sequence[int], least: int = 6) -> DataFrame:
    """Of the lags at which `a` (column x) and the later `b` (column y) have over `least` pairs, the one that correlates
    best, and its correlation."""
    moved = a.select(*keys, "x", F.col("t").alias("t_"), F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag")).withColumn("t", F.col("t_") + F.col("lag"))
    pairs = moved.join(b, [*keys, "t"]).groupBy(*keys, "lag").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n")).where((F.col("n") > least) & F.col("r").isNotNull())
    return pairs.groupBy(*keys).agg(F.min_by("lag", F.struct(-F.col("r"), F.abs("lag"), "lag")).alias("lag"), F.max("r").alias("r"))


def splice(past: DataFrame, forecast: DataFrame, bridge: DataFrame, keys: Sequence[str], now: int, value: str) -> DataFrame:
    """Observed until `now`, then the forecast; steps that neither has come from the bridge, or are 0."""
    part = lambda d, cond, rank: d.where(cond).select(*keys, "t", F.col(value).alias("v_"), F.lit(rank).alias("r_"))
    rows = part(past, F.col("t") <= now, 0).unionByName(part(forecast, F.col("t") > now, 1))
    axis = spine(rows, keys)
    have = rows.unionByName(part(bridge, F.lit(True), 2)).groupBy(*keys, "t").agg(F.min_by("v_", "r_").alias(value), F.min("r_").alias("r_"))
    label = F.element_at(F.array(*[F.lit(x) for x in ("observed", "forecast", "bridge", "none")]), F.coalesce("r_", F.lit(3)) + 1)
    return axis.join(have, [*keys, "t"], "left").select(*keys, "t", F.coalesce(value, F.lit(0.0)).alias(value), label.alias("origin"))


def fading_sum(df: DataFrame, keys: Sequence[str], value: str, hours: float, out: str, gain: float = 1.0) -> DataFrame:
    """gain times the sum of all values up to each row, each weighed by exp(-age / hours): what the recurrence
    s[t] = exp(-1 / hours) s[t - 1] + gain v[t] gives, rows that are absent being 0.

    Time is cut into blocks of 32 times `hours`. Within a block it is a running sum of values that were scaled to the
    block's start; of what lies before the block, only the block before it still counts (older values weigh less than
    e^-32 of their size). So a series of any length is many groups, and no scale overflows."""
    size = max(1, math.ceil(32 * hours))
    block = F.floor(F.col("t") / size)
    since = (F.col("t") - F.col("block_") * size) / hours
    rows = df.withColumn("block_", block)
    carried = rows.groupBy(*keys, (F.col("block_") + 1).alias("block_")).agg(F.sum(F.col(value) * F.exp(since - size / hours)).alias("before_"))
    within = F.sum(F.col(value) * F.exp(since)).over(Window.partitionBy(*keys, "block_").orderBy("t"))
    both = rows.withColumn("within_", within).join(carried, [*keys, "block_"], "left")
    total = (F.coalesce("within_", F.lit(0.0)) + F.coalesce("before_", F.lit(0.0))) * F.exp(-since) * gain
    return both.withColumn(out, total).select(*df.columns, out)


def antecedent_index(df: DataFrame, keys: Sequence[str], value: str, tau: float, out: str) -> DataFrame:
    """Exponentially decaying sum of the past (see fading_sum)."""
    return fading_sum(df, keys, value, tau, out)


def _per_key(df: DataFrame, keys: Sequence[str], fn, schema: str) -> DataFrame:
    return df.groupBy(*keys).applyInPandas(fn, schema)


def _types(df: DataFrame, names: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def decluster(df: DataFrame, keys: Sequence[str], value: str, apart: int) -> DataFrame:
    """Peaks in order of size, each of which suppresses others less than `apart` from it. Order matters, so each key's
    series is one pass of numpy."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([value, "t"], ascending=[False, True], kind="stable")
        kept: list[int] = []
        chosen = []
        for i, t in zip(pdf.index, pdf["t"].to_numpy(), strict=True):
            if all(abs(t - k) >= apart for k in kept):
                kept.append(t)
                chosen.append(i)
        return pdf.loc[chosen]

    return _per_key(df.select(*keys, "t", value), keys, keep, _types(df, [*keys, "t", value]))


def despike(df: DataFrame, keys: Sequence[str], value: str, left: float = 0.4, fall: float = 2.0, band: float = 0.12, longest: int = 72, entry: float = 0.5, passes: int = 4) -> DataFrame:
    """keys, t, value and clean. Plateaus that end in one step, by a fall of over `fall` to less than `left` of their height, stay
    within `band` of it for at most `longest` rows after their first, and were entered from below `entry` of it, are null in
    clean, with the two rows before and the two after (the samples of the transition). Plateaus may be stacked, so up to
    `passes` passes look at what is left; each judges all falls of the same rows.

    Falls are rare. Each meets the rows before it by a join on stretches of its series, and the last of these that is off
    its height tells where the plateau began. A null value is left out of the series, and clean there. Repeated times are
    rows of their own, in any order."""
    series = df.select(*keys, "t", value).withColumn("row_", F.monotonically_increasing_id())
    series = durable(series)
    left_over = series.where(F.col(value).isNotNull())
    span = longest + 1
    stretch = lambda n: F.floor(n / span)
    for _ in range(passes):
        at, after = F.row_number().over(_by(keys, "t", "row_")), F.lead(value).over(_by(keys, "t", "row_"))
        now = durable(left_over.withColumn("n_", at).withColumn("next_", after))
        ends = now.where((F.col("next_") < left * F.col(value)) & (F.col(value) - F.col("next_") > fall))
        ends = ends.select(*keys, F.col("n_").alias("end_"), F.col(value).alias("level_"), F.explode(F.array(stretch(F.col("n_")), stretch(F.col("n_")) - 1)).alias("stretch_"))
        before = now.select(*keys, "n_", value, stretch(F.col("n_")).alias("stretch_"))
        off = ends.join(before, [*keys, "stretch_"]).where((F.col("n_") < F.col("end_")) & (F.col("n_") >= F.col("end_") - span) & (F.abs(F.col(value) - F.col("level_")) > band * F.col("level_")))
        entered = off.groupBy(*keys, "end_", "level_").agg(F.max_by(F.struct("n_", value), "n_").alias("b_")).where(F.col(f"b_.{value}") < entry * F.col("level_"))
        gone = durable(entered.select(*keys, F.explode(F.sequence(F.col("b_.n_") - 1, F.col("end_") + 2)).alias("n_")).distinct())
        if gone.isEmpty():
            break
        left_over = now.join(gone, [*keys, "n_"], "left_anti").select(*left_over.columns)
    kept = left_over.select("row_", F.col(value).alias("clean"))
    return series.join(kept, "row_", "left").select(*keys, "t", value, "clean")
