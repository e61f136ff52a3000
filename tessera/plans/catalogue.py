"""Named queries over the star schema and the event stream, each with the SQL that says what it returns.

The tables stand in for the engine's own kinds: events are gauges (user_id), members (event_type) and rain (value), parts
are cells of fields of 20 x 10, suppliers and customers are places, lineitem holds forecasts and what came of them.
Amounts are summed in whole cents, so that sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(value: str) -> Column:
    return F.round(F.col(value) * 100).cast("long")


def hourly(spark: SparkSession, sf_dir: str, key: str = "user_id") -> DataFrame:
    """s, t (hour end, in hours since 1970), c (cents), n."""
    from tessera.operators.windows import step_end

    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col(key).alias("s"), step_end(F.col("ts")).alias("t")).agg(F.sum(cents("value")).alias("c"), F.count("*").alias("n"))


def hourly_sql(key: str = "user_id", name: str = "hourly") -> str:
    return f"{name} AS (SELECT {key} AS s, CAST(ceil(epoch_us(ts) / 3600000000.0) AS BIGINT) AS t, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS c, count(*) AS n FROM events GROUP BY 1, 2)"


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plane, j, i, v: parts as fields of 20 x 10 cells."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.floor(k / 200).alias("plane"), F.floor(k % 200 / 10).cast("int").alias("j"), (k % 10).cast("int").alias("i"), F.col("p_size").cast("double").alias("v"))


FIELD = "field AS (SELECT p_partkey // 200 AS plane, CAST(p_partkey % 200 // 10 AS INT) AS j, CAST(p_partkey % 10 AS INT) AS i, CAST(p_size AS DOUBLE) AS v FROM part)"

#: Hour 473448 is the end of the first hour before 5 January 2024, 00:00.
START = 473448


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]
