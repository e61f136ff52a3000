"""Forecast verification: contingency, Brier skill, reliability, ROC, leave-one-group-out choice, resampling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.storage import durable


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def contingency(df: DataFrame, keys: Sequence[str], warned: Column, event: Column, weight: str | None = None) -> DataFrame:
    """hits, misses, false alarms, correct negatives, and POD, FAR, CSI and frequency bias (null where undefined)."""
    w = F.col(weight) if weight else F.lit(1)
    n = lambda c: F.sum(F.when(c, w).otherwise(0))
    out = df.groupBy(*keys).agg(n(warned & event).alias("hits"), n(~warned & event).alias("misses"), n(warned & ~event).alias("false_alarms"), n(~warned & ~event).alias("negatives"))
    h, m, f = F.col("hits"), F.col("misses"), F.col("false_alarms")
    return out.withColumns({"pod": _ratio(h, h + m), "far": _ratio(f, h + f), "csi": _ratio(h, h + m + f), "bias": _ratio(h + f, h + m)})


def scores_by_groups(df: DataFrame, sets: Sequence[Sequence[str]], warned: Column, event: Column) -> DataFrame:
    """Contingency for several groupings in one pass (GROUPING SETS)."""
    names = list(dict.fromkeys(n for s in sets for n in s))
    grouped = df.groupingSets([[F.col(n) for n in s] for s in sets], *[F.col(n) for n in names])
    n = lambda c: F.sum(c.cast("long"))
    out = grouped.agg(F.grouping_id().cast("int").alias("gid"), n(warned & event).alias("hits"), n(~warned & event).alias("misses"), n(warned & ~event).alias("false_alarms"))
    h, m, f = F.col("hits"), F.col("misses"), F.col("false_alarms")
    return out.withColumn("csi", _ratio(h, h + m + f))


def brier_skill(df: DataFrame, keys: Sequence[str], p: str, event: str, base: Column | None = None, weight: str | None = None) -> DataFrame:
    """Brier score, that of the base rate (the key's own, unless given) and the skill. With the base rate r and the mean
    event o, the reference is r^2 - 2 r o + o, so that one pass suffices."""
    w = F.col(weight) if weight else F.lit(1.0)
    o = F.col(event).cast("double")
    sums = df.groupBy(*keys).agg(F.sum(w).alias("n"), (F.sum(w * F.pow(F.col(p) - o, F.lit(2.0))) / F.sum(w)).alias("bs"), (F.sum(w * o) / F.sum(w)).alias("o_"))
    r = base if base is not None else F.col("o_")
    out = sums.withColumn("bs_ref", r * r - 2 * r * F.col("o_") + F.col("o_"))
    return out.withColumn("bss", 1.0 - _ratio(F.col("bs"), F.col("bs_ref"))).drop("o_")


#: Edges of the bins of a reliability curve: narrow where forecasts of rare events are. Fixed values.
EDGES = (0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9)


def reliability(df: DataFrame, keys: Sequence[str], p: str, event: str, edges: Sequence[float] = EDGES) -> DataFrame:
    """Number, mean probability and event frequency by bin; a bin has its lower edge."""
    b = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col(p) + 1e-9)) - 1
    return df.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(event).cast("double")).alias("frequency"))


def leave_one_out(df: DataFrame, candidate: str, group: str, loss: str) -> DataFrame:
    """For each group the candidate with the least loss over all other groups, and its loss on the group itself: totals
    less the group's own, so no group is read twice."""
    own = df.groupBy(candidate, group).agg(F.sum(loss).alias("own"))
    rest = own.withColumn("rest", F.sum("own").over(Window.partitionBy(candidate)) - F.col("own"))
    return rest.groupBy(group).agg(F.min_by(F.struct(candidate, "rest", "own"), F.struct("rest", candidate)).alias("b")).select(group, "b.*")


def roc_area(df: DataFrame, keys: Sequence[str], score: str, event: str, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve, ties counting half. Equal scores are summed first."""
    w = F.col(weight) if weight else F.lit(1.0)
    hit = F.col(event).cast("boolean")
    by = df.groupBy(*keys, score).agg(F.sum(F.when(hit, w).otherwise(0.0)).alias("p_"), F.sum(F.when(~hit, w).otherwise(0.0)).alias("n_"))
    below = F.coalesce(F.sum("n_").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = by.withColumn("won_", F.col("p_") * (below + F.col("n_") / 2))
    return rows.groupBy(*keys).agg(_ratio(F.sum("won_"), F.sum("p_") * F.sum("n_")).alias("auc"), F.sum("p_").alias("events"), F.sum("n_").alias("others"))


def threshold_curve(df: DataFrame, keys: Sequence[str], p: str, event: str, bins: int = 200) -> DataFrame:
    """Contingency at each of `bins` + 1 thresholds, from the histogram: the bins at or above are cumulated."""
    from tessera.operators.weighted import tally

    h = tally(df, keys, p, event, bins)
    w = Window.partitionBy(*keys)
    up = w.orderBy(F.desc("bin"))
    rows = h.select(*keys, "bin", F.sum("hits").over(up).alias("hits"), (F.sum("n").over(up) - F.sum("hits").over(up)).alias("false_alarms"), F.sum("hits").over(w).alias("events_"))
    m = F.col("events_") - F.col("hits")
    return rows.select(*keys, (F.col("bin") / bins).alias("tau"), "hits", m.alias("misses"), "false_alarms", _ratio(F.col("hits"), F.col("events_") + F.col("false_alarms")).alias("csi"), _ratio(F.col("hits"), F.col("events_")).alias("pod"), _ratio(F.col("false_alarms"), F.col("hits") + F.col("false_alarms")).alias("far"))


def best_threshold(curve: DataFrame, keys: Sequence[str], slack: float = 0.005) -> DataFrame:
    """The greatest threshold whose CSI is within `slack` of the best."""
    top = curve.groupBy(*keys).agg(F.max("csi").alias("top_")) if keys else curve.agg(F.max("csi").alias("top_"))
    joined = curve.join(top, list(keys)) if keys else curve.crossJoin(top)  # one row
    return joined.where(F.col("csi") >= F.col("top_") - slack).groupBy(*keys).agg(F.max("tau").alias("tau"), F.max_by("csi", "tau").alias("csi"))


def threshold_for_pod(curve: DataFrame, keys: Sequence[str], pod: float) -> DataFrame:
    """The greatest threshold with at least that probability of detection."""
    return curve.where(F.col("pod") >= pod).groupBy(*keys).agg(F.max("tau").alias("tau"), F.max_by("far", "tau").alias("far"))


def draw(*parts: Column | str) -> Column:
    """A whole number from 0 to 2^48 - 1 that depends on the parts alone: the first 12 hex digits of their MD5, joined by colons.
    Other engines can draw the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])), 1, 12), 16, 10).cast("long")


def bootstrap(df: DataFrame, group: str, sums: Sequence[str], statistic: Column, times: int = 400, seed: int = 1) -> DataFrame:
    """p05, p50 and p95 of a statistic of sums, over `times` resamples of as many groups as there are, drawn with replacement.
    Groups (cases) are few: their totals come first, and only these are resampled."""
    totals = df.groupBy(group).agg(*[F.sum(s).alias(s) for s in sums])
    numbered = totals.withColumn("one_", F.lit(1)).withColumn("at_", F.row_number().over(Window.partitionBy("one_").orderBy(group)) - 1)
    n = F.max("at_") + 1
    slots = numbered.agg(n.alias("n_")).select("n_", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("draw_")).select("n_", "draw_", F.explode(F.sequence(F.lit(0), F.col("n_") - 1)).alias("slot_"))
    picked = slots.withColumn("at_", F.pmod(draw(F.lit(seed), "draw_", "slot_"), "n_").cast("int")).join(numbered, "at_")
    drawn = picked.groupBy("draw_").agg(*[F.sum(s).alias(s) for s in sums]).select(statistic.alias("x"))
    return drawn.agg(*[F.percentile("x", F.lit(q)).alias(n) for n, q in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))])


def error_scores(df: DataFrame, keys: Sequence[str], estimate: str, truth: str, wet: float = 1.0) -> DataFrame:
    e = F.col(estimate) - F.col(truth)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.sum(estimate) / F.nullif(F.sum(truth), F.lit(0.0))).alias("bias"), F.avg(F.abs(e)).alias("mae"),
        F.avg(F.when(F.col(truth) >= wet, F.abs(e))).alias("mae_wet"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr(estimate, truth).alias("r"),
    )


def log_residuals(df: DataFrame, keys: Sequence[str], sim: str, obs: str, offset: float, weight: str) -> DataFrame:
    """Weighted mean, mean size and spread of ln((sim + offset) / (obs + offset))."""
    r = F.log((F.col(sim) + offset) / (F.col(obs) + offset))
    w = F.sum(weight)
    rows = df.withColumn("r_", r)
    mean = F.sum(F.col(weight) * F.col("r_")) / w
    return rows.groupBy(*keys).agg(mean.alias("bias"), (F.sum(F.col(weight) * F.abs("r_")) / w).alias("mae"), F.sqrt(F.greatest(F.sum(F.col(weight) * F.col("r_") * F.col("r_")) / w - mean * mean, F.lit(0.0))).alias("sd"))


def attached(rows: DataFrame, facts: DataFrame, on: Sequence[str]) -> DataFrame:
    """rows with the other columns of facts (one row for each value of `on`), where nulls are equal."""
    f = facts.withColumnsRenamed({c: f"{c}_f_" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"{c}_f_")) for c in on] or [F.lit(True)]  # without keys facts are one row
    return rows.join(f, same).drop(*[f"{c}_f_" for c in on])


def counted_below(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value, n_ (rows with it) and below_ (rows of these keys with lesser values; null is the least). Different values are laid
    out by range and summed from part to part, so no key is one task."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n_"))
    laid = durable(counted.repartitionByRange(*keys, value).withColumn("part_", F.spark_partition_id()))
    parts, inside = Window.partitionBy(*keys).orderBy("part_"), Window.partitionBy(*keys, "part_").orderBy(value)
    upto = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = laid.groupBy(*keys, "part_").agg(F.sum("n_").alias("b_")).withColumn("b_", upto("b_", parts))
    return attached(laid, before, [*keys, "part_"]).select(*keys, value, "n_", (F.col("b_") + upto("n_", inside)).alias("below_"))


def rank_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Spearman's, with mean ranks for ties."""
    rows = df.select(*keys, x, y)
    for c, name in ((x, "rx_"), (y, "ry_")):
        ranks = counted_below(df, keys, c).select(*keys, c, (F.col("below_") + (F.col("n_") + 1) / 2).alias(name))
        rows = attached(rows, ranks, [*keys, c])
    return rows.groupBy(*keys).agg(F.corr("rx_", "ry_").alias("spearman"), F.count("*").alias("n"))


def folds(df: DataFrame, keys: Sequence[str], ident: str, k: int, seed: int) -> DataFrame:
    """Splits the ids of each key evenly into k folds, in the order of a hash."""
    ids = df.select(*keys, ident).distinct()
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(draw(F.lit(seed), ident), ident))
    return df.join(ids.withColumn("fold", (n - 1) % k), [*keys, ident])


def isotonic(df: DataFrame, keys: Sequence[str], p: str, event: str, bins: int = 200) -> DataFrame:
    """Rising event frequency by probability bin, by pooling adjacent violators. The histogram bounds what a task gets."""
    from tessera.operators.weighted import tally

    h = tally(df, keys, p, event, bins)
    kinds = dict(h.dtypes)

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        stack: list[list[float]] = []
        for n, hits in zip(pdf["n"], pdf["hits"], strict=True):
            stack.append([float(n), float(hits), 1])
            while len(stack) > 1 and stack[-2][1] / stack[-2][0] >= stack[-1][1] / stack[-1][0]:
                n1, h1, k1 = stack.pop()
                stack[-1] = [stack[-1][0] + n1, stack[-1][1] + h1, stack[-1][2] + k1]
        return pdf[[*keys, "bin", "n"]].assign(frequency=np.repeat([b[1] / b[0] for b in stack], [int(b[2]) for b in stack]))

    return h.groupBy(*keys).applyInPandas(pool, ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "bin", "n"]) + ", frequency double")


def cost_loss_threshold(fitted: DataFrame, keys: Sequence[str], ratio: float, bins: int = 200) -> DataFrame:
    """The least probability, 0.005 at least, whose fitted frequency reaches the cost-loss ratio."""
    return fitted.where(F.col("frequency") >= ratio).groupBy(*keys).agg(F.round(F.greatest(F.min("bin") / bins, F.lit(0.005)), 3).alias("tau"))


def value_ranks(others: DataFrame, keys: Sequence[str], group: str, value: str, least: int = 20) -> DataFrame:
    """keys, group, value, n (rows with them) and rank: the mid-rank (0 to 1) of each value of a group among the values of other groups
    with the same keys; null if too few. Values are counted and cumulated for the keys and for each group of them; what is a
    group's own is taken off. So rows are only counted, however many have one value."""
    every, own = counted_below(others, keys, value), counted_below(others, [*keys, group], value)
    own = own.withColumnsRenamed({"n_": "own_n_", "below_": "own_below_"})
    totals = lambda ks, name: own.groupBy(*ks).agg(F.sum("own_n_").alias(name))
    both = attached(own, every, [*keys, value])
    both = attached(attached(both, totals(keys, "all_"), keys), totals([*keys, group], "own_all_"), [*keys, group])
    n = F.col("all_") - F.col("own_all_")
    rank = F.when(n >= least, (F.col("below_") - F.col("own_below_") + (F.col("n_") - F.col("own_n_")) / 2) / n)
    return both.select(*keys, group, value, F.col("own_n_").alias("n"), rank.alias("rank"))


def feature_rank(df: DataFrame, others: DataFrame, keys: Sequence[str], group: str, value: str, least: int = 20) -> DataFrame:
    """Each row of others, where its group is in df, with the rank of its value (see value_ranks)."""
    ranked = attached(others, value_ranks(others, keys, group, value, least).drop("n"), [*keys, group, value])
    return ranked.join(df.select(*keys, group).distinct(), [*keys, group], "left_semi")


def fit_logistic(df: DataFrame, features: Sequence[str], event: str, weight: str | None = None, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Intercept and coefficients of a ridge logistic regression by Newton steps. Each step is one aggregate of
    (k + 1)(k + 2) / 2 sums; only these come to the driver."""
    names = ["one_", *features]
    rows = df.select(*features, event, *([weight] if weight else []), F.lit(1.0).alias("one_")).persist()  # read once a step
    w = F.col(weight) if weight else F.lit(1.0)
    beta = np.zeros(len(names))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    for _ in range(rounds):
        z = sum((F.col(n) * float(b) for n, b in zip(names[1:], beta[1:], strict=True)), F.lit(float(beta[0])))
        p = 1.0 / (1.0 + F.exp(-z))
        got = rows.withColumn("p_", p).agg(
            *[F.sum(w * (F.col(event).cast("double") - F.col("p_")) * F.col(n)) for n in names], *[F.sum(w * F.col("p_") * (1 - F.col("p_")) * F.col(names[i]) * F.col(names[j])) for i, j in pairs]
        ).first()
        g, h = np.array(got[: len(names)], float), np.zeros((len(names),) * 2)
        for (i, j), x in zip(pairs, got[len(names) :], strict=True):
            h[i, j] = h[j, i] = x
        penalty = np.diag([0.0] + [ridge] * len(features))
        step = np.linalg.solve(h + penalty, g - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    rows.unpersist()
    return beta
