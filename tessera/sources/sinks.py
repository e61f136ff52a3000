"""Sinks: partitions that replace themselves, archives, and snapshots that are checked before they are published."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replaces only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever the session's file system keeps it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession, path: str, by: str) -> list:
    """Values of the partition column that a folder has, in order; none if there is no folder. A partition is an hour, a block
    or a version, so they are few."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return []
    return [r[0] for r in spark.read.parquet(path).select(by).distinct().orderBy(by).collect()]


def retain(spark: SparkSession, path: str, by: str, newest: int) -> list:
    """Deletes the partitions but for the newest ones; gives what was deleted."""
    gone = partitions(spark, path, by)[:-newest]
    for v in gone:
        forget(spark, f"{path}/{by}={v}")
    return gone


def archive(df: DataFrame, path: str, at: int, every: int = 3) -> bool:
    """Keeps the state of a cycle under its hour, if it is one of those kept (every 3 hours). A cycle that comes again replaces
    itself."""
    if at % every:
        return False
    overwrite_partitions(df.withColumn("at", F.lit(at)), path, ["at"])
    return True


def backfill(missing: DataFrame, latest: Column, most: int = 2, back: int = 14) -> DataFrame:
    """The hours to read again: where over `most` hours (t) of a source are missing, all of the last `back` until `latest`; else
    the missing ones. missing: source, t."""
    n = missing.groupBy("source").agg(F.count("*").alias("n_"), F.collect_set("t").alias("t_"))  # at most `back` hours count
    hours = F.when(F.col("n_") > most, F.sequence(latest - back + 1, latest)).otherwise(F.sort_array("t_"))
    return n.select("source", F.explode(hours).alias("t")).where(F.col("t") > latest - back)


def build_blocks(spark: SparkSession, blocks: list[str], make, path: str) -> list[str]:
    """Builds the blocks that are not there yet, one partition each (make(block) gives its rows), so that a build that was
    broken off goes on where it was; gives what was built."""
    have = {str(b) for b in partitions(spark, path, "block")}
    todo = [b for b in blocks if b not in have]
    for b in todo:
        overwrite_partitions(make(b).withColumn("block", F.lit(b)), path, ["block"])
    return todo


def publish(df: DataFrame, path: str, checks: dict[str, Column], version: str) -> dict[str, bool]:
    """Writes a version of a snapshot if all checks (aggregate conditions) hold; otherwise the last good one stands."""
    got = df.agg(*[c.alias(n) for n, c in checks.items()]).first().asDict()
    if all(got.values()):
        df.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)
    return {n: bool(v) for n, v in got.items()}


def last_version(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    newest = df.agg(F.max("version")).first()[0]
    return df.where(F.col("version") == newest)


def packed_bytes(df: DataFrame, keys: Sequence[str], order: str, code: str) -> DataFrame:
    """Base64 of one byte for each row of a key, in order: a frame's cells, of which a grid has a fixed number."""
    hexed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, code))), lambda x: F.lpad(F.hex(x[code]), 2, "0")), "")
    return df.groupBy(*keys).agg(F.base64(F.unhex(hexed)).alias("packed"))


def unpacked_bytes(df: DataFrame, keys: Sequence[str], packed: str) -> DataFrame:
    """pos and code of each byte."""
    text = F.hex(F.unbase64(packed))
    codes = F.transform(F.sequence(F.lit(0), (F.length(text) / 2).cast("int") - 1), lambda k: F.conv(F.substring(text, k * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return df.select(*keys, F.posexplode(codes).alias("pos", "code"))
