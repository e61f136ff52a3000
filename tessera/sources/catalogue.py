"""Catalogues of model runs and networks of stations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.joins import latest, unite


def latest_runs(runs: DataFrame, n: int = 1) -> DataFrame:
    """The n newest complete runs of each model: runs (model, run, complete)."""
    return latest(runs.where("complete"), ["model"], ["run"], n)


def read_fields(spark: SparkSession, path: str, model: str, runs: Sequence, variables: Sequence[str], box: tuple[float, float, float, float] | None = None, times: tuple | None = None) -> DataFrame:
    """Values of a forecast store partitioned by model, run and variable. Models, runs and variables prune folders; the
    box (south, north, west, east) and times go to the Parquet scan as filters."""
    df = spark.read.parquet(path).where((F.col("model") == model) & F.col("run").isin(*runs) & F.col("variable").isin(*variables))
    if box:
        df = df.where(F.col("lat").between(box[0], box[1]) & F.col("lon").between(box[2], box[3]))
    if times:
        df = df.where(F.col("valid_time").between(*times))
    return df


def ensemble_summary(df: DataFrame, keys: Sequence[str], value: str, thresholds: Sequence[float]) -> DataFrame:
    """Mean, median, 90 % quantile and greatest member, and the share of members at or over each threshold."""
    shares = [F.avg((F.col(value) >= x).cast("double")).alias(f"p_{x:g}") for x in thresholds]
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.9)).alias("p90"), F.max(value).alias("top"), *shares)


def region_scalars(df: DataFrame, keys: Sequence[str], member: str, value: str) -> DataFrame:
    """Mean over members of each member's greatest value in the region."""
    return df.groupBy(*keys, member).agg(F.max(value).alias("m_")).groupBy(*keys).agg(F.avg("m_").alias(value))


def networks(spark: SparkSession, readers: dict[str, Callable[[SparkSession], DataFrame]], restricted: Sequence[str] = (), allowed: bool = False) -> tuple[DataFrame | None, dict[str, str]]:
    """The union of all networks that can be read, and a report. A network whose reader fails is reported and left out;
    restricted ones are only read where that is allowed."""
    parts, report = [], {}
    for name, reader in readers.items():
        if name in restricted and not allowed:
            report[name] = "restricted"
            continue
        try:
            parts.append(reader(spark).withColumn("network", F.lit(name)))
            report[name] = "ok"
        except Exception as e:  # whatever a foreign source does must not stop the others
            report[name] = f"{type(e).__name__}: {str(e)[:200]}"
    return (unite(*parts) if parts else None), report


def fresh(df: DataFrame, at: str, now: Column, minutes: int) -> DataFrame:
    """Rows no older than so many minutes."""
    return df.where(F.col(at) >= now - F.make_dt_interval(mins=F.lit(minutes)))


def complete_years(df: DataFrame, keys: Sequence[str], day: str, value: str, most_missing: int = 15) -> DataFrame:
    """Yearly maxima of daily values, of years with at least 350 days, or 330 of which 116 lie in September to December."""
    autumn = F.count(F.when(F.month(day) >= 9, F.col(value)))
    g = df.groupBy(*keys, F.year(day).alias("year")).agg(F.max(value).alias("top"), F.count(value).alias("n"), autumn.alias("autumn"))
    return g.where((F.col("n") >= 365 - most_missing) | ((F.col("n") >= 330) & (F.col("autumn") >= 116))).drop("autumn")
