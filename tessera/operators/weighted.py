"""Weighted statistics, quantiles and grouped reductions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.storage import durable


def step_quantiles(df: DataFrame, keys: Sequence[str], value: str, weight: str, qs: dict[str, float]) -> DataFrame:
    """Weighted mean and step quantiles of each key: the least value at which the cumulated share of weights reaches q.
    Null values or weights take no part; a key without positive weight has nulls.

    Equal values are summed before the window, which so sees each value of a key once.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull()).groupBy(*keys, F.col(value).alias("v_")).agg(F.sum(weight).alias("w_"))
    w = Window.partitionBy(*keys)
    share = F.sum("w_").over(w.orderBy("v_")) / F.nullif(F.sum("w_").over(w), F.lit(0.0))
    cum = rows.withColumn("c_", share)
    outs = [F.min(F.when(F.col("c_") >= q - 1e-9, F.col("v_"))).alias(name) for name, q in qs.items()]
    return cum.groupBy(*keys).agg((F.sum(F.col("w_") * F.col("v_")) / F.nullif(F.sum("w_"), F.lit(0.0))).alias("mean"), *outs)


def midpoint_quantile(df: DataFrame, keys: Sequence[str], value: str, weight: str, q: float, out: str = "quantile") -> DataFrame:
    """Linear interpolation between values at the middle of their share of the weights; clamped at the ends."""
    w = Window.partitionBy(*keys)
    o = w.orderBy(value)
    at = (F.sum(weight).over(o.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight) / 2) / F.sum(weight).over(w)
    placed = df.withColumn("c_", at)
    before_c, before_v = F.lag("c_").over(w.orderBy("c_", value)), F.lag(value).over(w.orderBy("c_", value))
    rows = placed.withColumn("bc_", before_c).withColumn("bv_", before_v)
    line = F.col("bv_") + (q - F.col("bc_")) / (F.col("c_") - F.col("bc_")) * (F.col(value) - F.col("bv_"))
    hit = F.min(F.when((F.col("c_") >= q) & (F.coalesce("bc_", F.lit(-1.0)) < q), F.coalesce(line, F.col(value))))
    return rows.groupBy(*keys).agg(F.coalesce(hit, F.max_by(value, F.struct("c_", value))).alias(out))


def linear_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.percentile(value, F.lit(q)).alias(n) for n, q in qs.items()])


def normalised_weights(df: DataFrame, keys: Sequence[str], weight: str, present: Column, out: str = "share") -> DataFrame:
    """Weights of present members over the sum of these; 0 for the others."""
    own = F.when(present, F.col(weight)).otherwise(0.0)
    return df.withColumn(out, own / F.nullif(F.sum(own).over(Window.partitionBy(*keys)), F.lit(0.0)))


def sparse_product(edges: DataFrame, values: DataFrame, on: Sequence[str], to: Sequence[str], weight: str, value: str, out: str, mean: bool = True) -> DataFrame:
    """Matrix times vector: edges (on, to, weight) with values (on, value). mean: over the weights of known values."""
    known = F.when(F.col(value).isNotNull(), F.col(weight))
    total = F.sum(F.col(weight) * F.col(value))
    return edges.join(values, list(on)).groupBy(*to).agg((total / F.nullif(F.sum(known), F.lit(0.0)) if mean else total).alias(out))


def ratio_summary(df: DataFrame, keys: Sequence[str], ratio: str, weight: str) -> DataFrame:
    """Features of weighted threshold ratios: log of their mean, logits of the shares that reach 1 and 0.5 (half a
    part in a hundred from the ends), log of the 90 % step quantile."""
    shares = df.groupBy(*keys).agg(
        *[(F.sum(F.when(F.col(ratio) >= x, F.col(weight)).otherwise(0.0)) / F.sum(weight)).alias(n) for n, x in (("share1", 1.0), ("share05", 0.5))]
    )
    q = step_quantiles(df, keys, ratio, weight, {"q90": 0.9})
    edge = lambda c: F.greatest(F.least(F.col(c), F.lit(0.995)), F.lit(0.005))
    logit = lambda c: F.log(edge(c) / (1.0 - edge(c)))
    return q.join(shares, list(keys)).select(*keys, F.log(F.greatest("mean", F.lit(1e-3))).alias("ln_mean"), logit("share1").alias("logit1"), logit("share05").alias("logit05"), F.greatest(F.log(F.greatest("q90", F.lit(1e-9))), F.lit(-6.0)).alias("ln_q90"))


def tally(df: DataFrame, keys: Sequence[str], p: str, event: str, bins: int = 200) -> DataFrame:
    """Counts by probability bin: mergeable, so partial counts add up."""
    return df.groupBy(*keys, F.least(F.floor(F.col(p) * bins + 1e-9), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("hits"))


def binned_means(df: DataFrame, keys: Sequence[str], x: Column, value: str, least: int, out: str = "mean") -> DataFrame:
    return df.groupBy(*keys, x.alias("bin")).agg(F.count(value).alias("n"), F.avg(value).alias(out)).where(F.col("n") >= least)


#: Different values of days that stand together, in their order.
RUN = 1 << 15


def circular_climatology(df: DataFrame, keys: Sequence[str], day: str, value: str, half: int, qs: dict[str, float], period: int = 366) -> DataFrame:
    """Quantiles of all values within `half` days of each day of the year, linear between order statistics.

    Equal values of a day are counted, laid out by value and cut into runs. A count of each day in each run tells in which run a
    day of the year has its order statistics, and only the values of these runs are met with it: neither are all values
    expanded to the days around, nor are those of a day of the year ever in one place."""
    from tessera.operators.verify import attached

    order = [*keys, value, day]
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(day), F.col(value)).agg(F.count("*").alias("n_"))
    laid = durable(counted.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("run_", F.floor(F.monotonically_increasing_id() / RUN))
    around = F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("d_")
    runs = durable(laid.groupBy(*keys, F.col(day), "run_").agg(F.sum("n_").alias("n_")))
    wide = runs.select(*keys, F.col(day), "run_", "n_", around).withColumn("doy", (F.col(day) - 1 + F.col("d_") + period) % period + 1)
    own = Window.partitionBy(*keys, "doy")
    upto = wide.groupBy(*keys, "doy", "run_").agg(F.sum("n_").alias("r_")).withColumns({"n": F.sum("r_").over(own), "upto_": F.sum("r_").over(own.orderBy("run_"))})
    at = {c: q * (F.col("n") - 1) for c, q in qs.items()}
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in at.values() for f in (F.floor, F.ceil)]))
    before = F.col("upto_") - F.col("r_")
    found = upto.withColumn("ranks_", F.filter(ranks, lambda r: (r >= before) & (r < F.col("upto_")))).where(F.size("ranks_") > 0)
    found = durable(found.select(*keys, "doy", "run_", "n", "ranks_", before.alias("before_")))  # at most two for each quantile and day of the year
    sought = attached(wide.drop("n_", "d_"), found, [*keys, "doy", "run_"])
    met = attached(laid, sought, [*keys, day, "run_"])
    last = F.col("before_") + F.sum("n_").over(Window.partitionBy(*keys, "doy", "run_").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ends = met.withColumn("last_", last).select(*keys, "doy", "n", F.col(value).cast("double").alias("v_"), F.explode(F.filter("ranks_", lambda r: (r >= F.col("last_") - F.col("n_")) & (r < F.col("last_")))).alias("rank_"))
    v = lambda x: F.max(F.when(F.col("rank_") == x.cast("long"), F.col("v_")))
    line = lambda x: F.when(F.floor(x) == F.ceil(x), v(F.floor(x))).otherwise((F.ceil(x) - x) * v(F.floor(x)) + (x - F.floor(x)) * v(F.ceil(x)))
    return ends.groupBy(*keys, "doy", "n").agg(*[line(x).alias(c) for c, x in at.items()])


def vector_mean(df: DataFrame, keys: Sequence[str], u: str, v: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.degrees(F.atan2(F.avg(u), F.avg(v))).alias("direction"), F.avg(F.sqrt(F.col(u) * F.col(u) + F.col(v) * F.col(v))).alias("speed"))


def quantiles_of_all(df: DataFrame, value: str, ps: Sequence[float]) -> list[float]:
    """Exact quantiles of a whole column, linear between order statistics; NaN if it has no values. Different values are counted
    and laid out by range; the sums of the parts tell which of them holds an order statistic, and only those values come
    to the driver, two for each quantile."""
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v_")).agg(F.count("*").alias("n_"))
    laid = durable(counted.repartitionByRange("v_").sortWithinPartitions("v_")).withColumn("part_", F.spark_partition_id())
    sizes = {r["part_"]: r["n"] for r in laid.groupBy("part_").agg(F.sum("n_").alias("n")).collect()}
    if not sizes:
        return [math.nan] * len(ps)
    before, total = [], 0
    for part in range(max(sizes) + 1):
        before.append(F.lit(total).cast("long"))
        total += sizes.get(part, 0)
    at = [p * (total - 1) for p in ps]
    ranks = sorted({r for x in at for r in (math.floor(x), math.ceil(x))})
    last = F.sum("n_").over(Window.partitionBy("part_").orderBy("v_")) + F.element_at(F.array(*before), F.col("part_") + 1)
    wanted = F.filter(F.array(*[F.lit(r).cast("long") for r in ranks]), lambda r: (r < F.col("last_")) & (r >= F.col("last_") - F.col("n_")))
    got = {r["rank"]: float(r["v_"]) for r in laid.withColumn("last_", last).select("v_", F.explode(wanted).alias("rank")).collect()}
    return [got[math.floor(x)] + (got[math.ceil(x)] - got[math.floor(x)]) * (x - math.floor(x)) for x in at]


def daily_climate(nodes: DataFrame, keys: Sequence[str], value: str, period: int = 366) -> DataFrame:
    """keys, day (0 to period - 1), value: a climate known at some days of the year, linear between them and around the year's end.

    Each node yields the days up to the next one, so what needs the climate of its day finds it by equality. One node holds for
    all days; of several at one day their mean counts; nodes without a value or outside the year are as if absent."""
    known = nodes.where(F.col(value).isNotNull() & F.col("day").between(0, period - 1)).groupBy(*keys, "day").agg(F.avg(value).alias("q_"))
    w = Window.partitionBy(*keys).orderBy("day")
    first = F.first(F.struct("day", "q_")).over(w)
    n = known.withColumns({"next_": F.coalesce(F.lead("day").over(w), first["day"] + period), "nq_": F.coalesce(F.lead("q_").over(w), first["q_"])})
    days = n.withColumn("d_", F.explode(F.sequence(F.col("day"), F.col("next_") - 1)))
    part = (F.col("d_") - F.col("day")) / (F.col("next_") - F.col("day"))
    return days.select(*keys, F.pmod(F.col("d_"), F.lit(period)).cast("int").alias("day"), (F.col("q_") + (F.col("nq_") - F.col("q_")) * part).alias(value))
