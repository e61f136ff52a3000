"""Streaming queries, run over the whole event table as a stream. Their SQL is that of the batch they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.catalogue import cents, query
from tessera.streaming import operators as S


def events(spark: SparkSession, sf: str, late: str = "40 days") -> DataFrame:
    e = S.read_files(spark, f"{sf}/events.parquet").withColumn("c", cents("value"))
    return S.event_time(e, "ts", late)


def closed(df: DataFrame, spark: SparkSession) -> DataFrame:
    """What a stream in complete mode has written last."""
    return S.last_batch(spark, S.run_once(df, "complete"))


@query("SELECT event_type, CAST(ceil(epoch_us(ts) / 3600000000.0) AS BIGINT) AS t, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS c FROM events GROUP BY 1, 2")
def stream_tumbling_hours(spark: SparkSession, sf: str) -> DataFrame:
    out = closed(S.tumbling(events(spark, sf), ["event_type"], "ts", "1 hour", [F.count("*").alias("n"), F.sum("c").alias("c")]), spark)
    return out.select("event_type", F.floor(F.unix_seconds("t") / 3600).alias("t"), "n", "c")


@query("""WITH e AS (SELECT event_type, CAST(ceil(epoch_us(ts) / 21600000000.0) AS BIGINT) * 6 AS h, CAST(round(value * 100) AS BIGINT) AS c FROM events) SELECT event_type, h + 6 * k AS t, CAST(sum(c) AS BIGINT) AS c FROM e, range(2) x(k) GROUP BY 1, 2""")
def stream_sliding_12h(spark: SparkSession, sf: str) -> DataFrame:
    out = closed(S.sliding(events(spark, sf), ["event_type"], "ts", "12 hours", "6 hours", [F.sum("c").alias("c")]), spark)
    return out.select("event_type", F.floor(F.unix_seconds("t") / 3600).alias("t"), "c")


@query("""WITH d AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM d)
SELECT user_id, CAST(floor(epoch_us(min(ts)) / 1000000) AS BIGINT) AS t0, count(*) AS n FROM i GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = S.sessions(events(spark, sf), ["user_id"], "ts", "6 hours", [F.count("*").alias("n")])
    return S.last_batch(spark, S.run_once(out, "complete")).select("user_id", F.floor(F.unix_micros("t0") / 1_000_000).alias("t0"), "n")


@query("SELECT user_id, event_type, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1, 2")
def stream_latest_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select("user_id", "event_type", "event_id", "ts")
    path = S.work_folder(spark)
    S.run_once(e, "append", path, S.upsert(spark, path, ["user_id", "event_type"], "ts"))
    return spark.read.parquet(path).select("user_id", "event_type", "event_id")


@query("""SELECT user_id, CAST(floor(epoch_us(max(ts)) / 1000000) AS BIGINT) AS at, round(sum(CAST(round(value * 100) AS BIGINT) * exp((epoch_us(ts) - m) / CAST(3600000000 AS DOUBLE) / 72)), 3) AS store FROM events JOIN (SELECT user_id AS u, epoch_us(max(ts)) AS m FROM events GROUP BY 1) ON u = user_id GROUP BY user_id""")
def stream_wetness_state(spark: SparkSession, sf: str) -> DataFrame:
    out = S.wetness(events(spark, sf), ["user_id"], "ts", "c", 72.0)
    folder = S.run_once(out, "update")
    rows = spark.read.parquet(folder)
    newest = rows.groupBy("user_id").agg(F.max_by(F.struct("at", "store"), "v").alias("b"))
    return newest.select("user_id", F.floor("b.at").alias("at"), F.round("b.store", 3).alias("store"))


@query("SELECT event_type, user_id, count(*) AS n FROM (SELECT DISTINCT event_type, user_id, CAST(floor(value) AS INT) AS v FROM events) GROUP BY 1, 2")
def stream_first_of_key(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("v", F.floor("value").cast("int"))
    folder = S.run_once(S.first_of(e.select("event_type", "user_id", "v", "ts"), ["event_type", "user_id", "v"]), "append")
    return spark.read.parquet(folder).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
