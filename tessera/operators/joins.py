"""Joins of runs, sources and states: as-of, donors, latest versions, unions of unlike tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 1) -> DataFrame:
    """The n newest rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]))
    return df.withColumn("rank_", rank).where(F.col("rank_") <= n).drop("rank_")


def latest_one(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key by a partial aggregate: a key with a third of all rows is no burden."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("b"))
    return best.select(*keys, "b.*").select(df.columns)


def runs_available(issues: DataFrame, runs: DataFrame, delay: Column | int, most_age: int, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """For each issue time (t) the n newest runs (run) that are published by then (run + delay <= t) and no older than
    most_age: rank from 1. Each run is sent to the days on which it can serve, so the join is on equality."""
    day = 24
    wide = runs.withColumn("d_", F.explode(F.sequence(F.floor((F.col("run") + delay) / day), F.floor((F.col("run") + most_age) / day))))
    pairs = issues.withColumn("d_", F.floor(F.col("t") / day)).join(wide, [*keys, "d_"]).where((F.col("run") + delay <= F.col("t")) & (F.col("t") - F.col("run") <= most_age))
    rank = F.row_number().over(Window.partitionBy(*keys, "t").orderBy(F.desc("run")))
    return pairs.drop("d_").withColumn("rank", rank).where(F.col("rank") <= n)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    """For each row of left (keys, t) the last value of right (keys, t) at or before it: one union, one sort."""
    out = out or value
    a = left.withColumn("side_", F.lit(1)).withColumn("v_", F.lit(None).cast(dict(right.dtypes)[value]))
    b = right.select(*keys, "t", F.col(value).alias("v_")).withColumn("side_", F.lit(0))
    w = Window.partitionBy(*keys).orderBy("t", "side_").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b, allowMissingColumns=True).withColumn(out, F.last("v_", ignorenulls=True).over(w)).where("side_ = 1").drop("side_", "v_")


def nearest_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, tolerance: float, out: str | None = None) -> DataFrame:
    """For each row of left (keys, t) the value of right (keys, t) that is nearest in time, before or after, and no further than the
    tolerance; null if there is none. Of two as near the earlier counts, of several at one time the greatest. Null values of
    right, and rows without a time, are as if absent. One union, one sort for each direction."""
    out, kind = out or value, dict(right.dtypes)[value]
    b = right.where(F.col(value).isNotNull() & F.col("t").isNotNull()).groupBy(*keys, "t").agg(F.max(value).alias("v_"))
    rows = left.withColumns({"side_": F.lit(1), "s_": F.lit(None).cast(f"struct<t:{dict(right.dtypes)['t']},v:{kind}>")})
    rows = rows.unionByName(b.select(*keys, "t", F.struct("t", F.col("v_").alias("v")).alias("s_")).withColumn("side_", F.lit(0)), allowMissingColumns=True)
    past = Window.partitionBy(*keys).orderBy("t", "side_").rowsBetween(Window.unboundedPreceding, 0)
    future = Window.partitionBy(*keys).orderBy(F.desc("t"), "side_").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"a_": F.last("s_", ignorenulls=True).over(past), "z_": F.last("s_", ignorenulls=True).over(future)}).where("side_ = 1")
    back, ahead = F.col("t") - F.col("a_.t"), F.col("z_.t") - F.col("t")
    found = F.when((back <= tolerance) & (ahead.isNull() | (back <= ahead)), F.col("a_.v")).when(ahead <= tolerance, F.col("z_.v"))
    return rows.withColumn(out, found).drop("side_", "s_", "a_", "z_")


def lead_series(runs: DataFrame, lead_days: Sequence[int], keys: Sequence[str], value: str, most_age: int = 36) -> DataFrame:
    """Of each valid time t and lead day L, the value of the newest run with run <= t - 24 L (L = 0: run < t) that has t,
    at most most_age hours older than that."""
    rows = runs.withColumn("lead_day", F.explode(F.array(*[F.lit(k) for k in lead_days])))
    last = F.when(F.col("lead_day") == 0, F.col("t") - 1).otherwise(F.col("t") - 24 * F.col("lead_day"))
    fit = rows.where((F.col("run") <= last) & (last - F.col("run") <= most_age))
    return fit.groupBy(*keys, "t", "lead_day").agg(F.max_by(value, "run").alias(value), F.max("run").alias("run"))


def fill_gaps(df: DataFrame, donors: DataFrame, keys: Sequence[str], value: str, factor: Column | float = 1.0) -> DataFrame:
    """Unknown values take that of the donor with the least `rank` which knows the place, times a factor, or 0."""
    best = donors.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, "rank").alias("d_"), F.min_by("donor", "rank").alias("donor"))
    factor = F.lit(factor) if isinstance(factor, float) else factor
    return df.join(best, list(keys), "left").withColumn("donor", F.when(F.col(value).isNull(), F.col("donor"))).withColumn(value, F.coalesce(value, F.col("d_") * factor, F.lit(0.0))).drop("d_")


def first_source(df: DataFrame, rank: str, least: int, keys: Sequence[str] = ()) -> DataFrame:
    """All rows of the first source that has at least `least` rows (per key)."""
    n = df.groupBy(*keys, rank).count().where(F.col("count") >= least)
    best = n.groupBy(*keys).agg(F.min(rank).alias(rank))
    return df.join(best, [*keys, rank], "left_semi")


def unite(*parts: DataFrame) -> DataFrame:
    """Union of tables with unlike columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def prefer(first: DataFrame, second: DataFrame, keys: Sequence[str], value: str, factor: float = 1.0) -> DataFrame:
    """Union of the keys of both, the first's value where it has one, else the second's times a factor."""
    b = second.select(*keys, F.col(value).alias("b_"))
    return first.select(*keys, value).join(b, list(keys), "full").select(*keys, F.coalesce(value, F.col("b_") * factor).alias(value))


def interval_overlap(segments: DataFrame, windows: DataFrame, keys: Sequence[str], value: str, share: float = 0.9, bucket: int = 24) -> DataFrame:
    """Amount of segments (a, b, value) within windows (wid, w0, w1), by share of overlap; null if less than `share` of the
    window is covered. Both sides go to the buckets they touch, so the join is on equality; a pair counts in the first."""
    touch = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor((F.col(b) - 1) / bucket)))
    s, w = segments.withColumn("k_", touch("a", "b")), windows.withColumn("k_", touch("w0", "w1"))
    over = F.least("b", "w1") - F.greatest("a", "w0")
    pairs = s.join(w, [*keys, "k_"]).where((over > 0) & (F.col("k_") == F.floor(F.greatest("a", "w0") / bucket)))
    sums = pairs.groupBy(*keys, "wid", "w0", "w1").agg(F.sum(F.col(value) * over / (F.col("b") - F.col("a"))).alias("amount"), F.sum(over).alias("covered"))
    return sums.select(*keys, "wid", F.when(F.col("covered") >= share * (F.col("w1") - F.col("w0")), F.col("amount")).alias("amount"), "covered")


def shares_of_profile(totals: DataFrame, profile: DataFrame, keys: Sequence[str], total: str, value: str, least: float = 1.0) -> DataFrame:
    """Totals dealt to the rows of a profile in proportion; evenly where the profile has less than `least`."""
    w = Window.partitionBy(*keys)
    p = F.when(F.sum(value).over(w) >= least, F.col(value) / F.sum(value).over(w)).otherwise(1.0 / F.count(F.lit(1)).over(w))
    return profile.withColumn("p_", p).join(totals, list(keys)).withColumn(value, F.col(total) * F.col("p_")).drop("p_")
