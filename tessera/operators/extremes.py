"""Extreme values: L-moments, GEV fits, return periods."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.special import gamma_function


def l_moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """l1, l2, t3 and t4 from probability-weighted moments of the ordered values."""
    w = Window.partitionBy(*keys)
    rows = df.where(F.col(value).isNotNull()).withColumn("k_", F.row_number().over(w.orderBy(value)) - 1).withColumn("n_", F.count("*").over(w))
    k, n, x = F.col("k_").cast("double"), F.col("n_").cast("double"), F.col(value)
    safe = lambda d: F.nullif(d, F.lit(0.0))
    b = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("b0"), F.avg(x * k / safe(n - 1)).alias("b1"), F.avg(x * k * (k - 1) / safe((n - 1) * (n - 2))).alias("b2"), F.avg(x * k * (k - 1) * (k - 2) / safe((n - 1) * (n - 2) * (n - 3))).alias("b3")
    )
    l2, l3, l4 = 2 * F.col("b1") - F.col("b0"), 6 * F.col("b2") - 6 * F.col("b1") + F.col("b0"), 20 * F.col("b3") - 30 * F.col("b2") + 12 * F.col("b1") - F.col("b0")
    return b.select(*keys, "n", F.col("b0").alias("l1"), l2.alias("l2"), (l3 / F.nullif(l2, F.lit(0.0))).alias("t3"), (l4 / F.nullif(l2, F.lit(0.0))).alias("t4"))


def gev_from_moments(df: DataFrame) -> DataFrame:
    """loc, scale and xi from l1, l2 and t3, by the usual rational approximation of the shape."""
    c = 2.0 / (3.0 + F.col("t3")) - 0.6309297535714574
    k = 7.8590 * c + 2.9554 * c * c
    k = F.when(F.abs(k) < 1e-6, 1e-6).otherwise(k)
    g = gamma_function(1.0 + k)
    scale = F.col("l2") * k / ((1.0 - F.pow(F.lit(2.0), -k)) * g)
    return df.withColumn("xi", -k).withColumn("scale", scale).withColumn("loc", F.col("l1") - scale * (1.0 - g) / k)


def regional(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sample-weighted mean ratios of many sites: L-CV, t3, and the weighted spread of L-CV (heterogeneity)."""
    cv, n = F.col("l2") / F.col("l1"), F.col("n")
    mean = lambda x: F.sum(n * x) / F.sum(n)
    return df.groupBy(*keys).agg(F.count("*").alias("sites"), mean(cv).alias("lcv"), mean(F.col("t3")).alias("t3"), F.sqrt(F.greatest(mean(cv * cv) - mean(cv) * mean(cv), F.lit(0.0))).alias("spread"))


def gev_bootstrap(df: DataFrame, keys: Sequence[str], value: str, years: float, times: int = 200, seed: int = 3) -> DataFrame:
    """Spread (p05, p95) of the return level over resampled years. A site's annual maxima are a bounded group."""
    import math

    import numpy as np

    kinds = dict(df.dtypes)

    def level(x: np.ndarray) -> np.ndarray:
        x = np.sort(x, axis=1)
        n = x.shape[1]
        k = np.arange(n)
        b0, b1, b2 = x.mean(axis=1), (x * k).mean(axis=1) / (n - 1), (x * k * (k - 1)).mean(axis=1) / ((n - 1) * (n - 2))
        l2 = 2 * b1 - b0
        c = 2 / (3 + (6 * b2 - 6 * b1 + b0) / l2) - math.log(2) / math.log(3)
        s = 7.859 * c + 2.9554 * c * c
        s = np.where(np.abs(s) < 1e-6, 1e-6, s)
        g = np.array([math.gamma(1 + v) if v > -1 else np.nan for v in s])
        scale = l2 * s / ((1 - 2.0**-s) * g)
        return b0 - scale * (1 - g) / s + scale * (1 - (-math.log(1 - 1 / years)) ** s) / s

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[value].dropna().to_numpy(float))
        head = {k: [pdf[k].iloc[0]] for k in keys}
        if len(x) < 4 or x[0] == x[-1]:
            return pd.DataFrame({**head, "p05": [np.nan], "p95": [np.nan]})
        drawn = level(x[np.random.default_rng(seed).integers(0, len(x), (times, len(x)))])
        return pd.DataFrame({**head, "p05": [np.nanpercentile(drawn, 5)], "p95": [np.nanpercentile(drawn, 95)]})

    return df.select(*keys, value).groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", p05 double, p95 double")
