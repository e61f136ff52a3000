"""Queries on whole fields and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import blend_weight
from tessera.operators import fields as X
from tessera.operators.grids import disc
from tessera.operators.windows import step_end
from tessera.plans.catalogue import FIELD, cents, field, query, r6, table

NY, NX = 20, 10


def gauges(spark: SparkSession, sf: str) -> DataFrame:
    return field(spark, sf).where((F.col("j") * 7 + F.col("i") * 3) % 11 == 0).select("plane", "j", "i", (F.col("v") * 1.3 + 1).alias("g"))


@query()
def conditional_merge(spark: SparkSession, sf: str) -> DataFrame:
    radar = field(spark, sf).select("plane", "j", "i", F.when(F.col("v") > 2, F.col("v")).alias("r"))
    return X.merge_gauges(radar, gauges(spark, sf), ["plane"])


BOX = ", ".join(f"({a}, {b})" for a, b in disc(12.0, 5.5, 4.4))


@query(f"""WITH {FIELD}, g AS (SELECT plane, j, i, v * CAST(0.6 AS DOUBLE) AS g, v / CAST(8 AS DOUBLE) AS r, v * CAST(0.6 AS DOUBLE) >= 20 AND v * CAST(0.6 AS DOUBLE) > CAST(2.5 AS DOUBLE) * greatest(v / CAST(8 AS DOUBLE), 1) AS weak FROM field WHERE (j * 7 + i * 3) % 11 = 0), o(dj, di) AS (VALUES {BOX}),
a AS (SELECT c.plane, c.j, c.i, max(g.g) AS top, count(g.g) AS n, coalesce(bool_or(weak), false) AS weak FROM field c, o LEFT JOIN g ON g.plane = c.plane AND g.j = least(greatest(c.j + dj, 0), {NY - 1}) AND g.i = least(greatest(c.i + di, 0), {NX - 1}) GROUP BY 1, 2, 3)
SELECT plane, j, i, round(CASE WHEN n >= 3 AND NOT weak THEN least(v * 3, 3 * top + 20) ELSE v * 3 END, 6) AS v FROM field JOIN a USING (plane, j, i)""")
def gauge_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    f = field(spark, sf)
    g = f.where((F.col("j") * 7 + F.col("i") * 3) % 11 == 0).select("plane", "j", "i", (F.col("v") * 0.6).alias("g"), (F.col("v") / 8).alias("r"))
    return X.ceiling(f.withColumn("v", F.col("v") * 3), g, ["plane"], "v", disc(12.0, 5.5, 4.4), NY, NX).select("plane", "j", "i", *r6("v"))


@query()
def closed_lows(spark: SparkSession, sf: str) -> DataFrame:
    return X.closed_lows(field(spark, sf), ["plane"], "v", 1)


@query()
def linked_tracks(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 200).alias("k"), (F.col("p_partkey") % 200 / 5).cast("long").alias("t"), F.col("p_size").cast("double").alias("y"), (F.col("p_partkey") * 7 % 50).cast("double").alias("x"))
    return X.link_tracks(p, ["k"], 15.0, 2)


@query()
def filled_depressions(spark: SparkSession, sf: str) -> DataFrame:
    return X.fill_depressions(field(spark, sf), ["plane"], "v")


@query(f"WITH {FIELD} SELECT plane, i, j, v, min(v) OVER (PARTITION BY plane, i ORDER BY j) AS carved FROM field")
def monotone_profile(spark: SparkSession, sf: str) -> DataFrame:
    return X.monotone_profile(field(spark, sf), ["plane", "i"], "j", "v")


@query(f"""WITH {FIELD}, p AS (SELECT plane, i, 300 + j * CAST(35 AS DOUBLE) AS p, v FROM field), s AS (SELECT plane, i, (v + lead(v) OVER w) / 2 * (lead(p) OVER w - p) AS part FROM p WINDOW w AS (PARTITION BY plane, i ORDER BY p)) SELECT plane, i, round(sum(part), 6) AS total FROM s GROUP BY 1, 2""")
def column_integral(spark: SparkSession, sf: str) -> DataFrame:
    p = field(spark, sf).withColumn("p", 300 + F.col("j") * 35.0)
    return X.column_integral(p, ["plane", "i"], "p", "v", "total").select("plane", "i", *r6("total"))


@query(f"""WITH {FIELD}, p AS (SELECT plane, i, 300 + j * CAST(35 AS DOUBLE) AS p, v FROM field), s AS (SELECT plane, i, p, lead(p) OVER w AS p1, v, lead(v) OVER w AS v1 FROM p WINDOW w AS (PARTITION BY plane, i ORDER BY p)), t(target) AS (VALUES (CAST(500 AS DOUBLE)), (CAST(850 AS DOUBLE)))
SELECT plane, i, target, round(v + (v1 - v) * ln(target / p) / ln(p1 / p), 6) AS v FROM s JOIN t ON target >= p AND target < p1""")
def value_at_pressure(spark: SparkSession, sf: str) -> DataFrame:
    p = field(spark, sf).withColumn("p", 300 + F.col("j") * 35.0)
    return X.at_pressure(p, ["plane", "i"], "p", "v", [500.0, 850.0]).select("plane", "i", "target", *r6("v"))


@query()
def parcel_indices(spark: SparkSession, sf: str) -> DataFrame:
    p = field(spark, sf).select("plane", "i", (1000 - F.col("j") * 40.0).alias("p"), (28 - F.col("j") * 3.6 + F.col("v") / 50).alias("temp"), (22 - F.col("j") * 4.5).alias("dewpoint"))
    return X.parcel_indices(p, ["plane", "i"])


@query(f"""WITH {FIELD}, c AS (SELECT plane, j, i, j - CAST(1.25 AS DOUBLE) AS y, i + CAST(0.5 AS DOUBLE) AS x FROM field), k AS (SELECT *, floor(y) AS y0, floor(x) AS x0 FROM c WHERE y >= 0 AND y <= {NY - 1} AND x >= 0 AND x <= {NX - 1}), o(a, b) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1))
SELECT k.plane, k.j, k.i, round(sum((CASE WHEN a = 1 THEN y - y0 ELSE 1 - (y - y0) END) * (CASE WHEN b = 1 THEN x - x0 ELSE 1 - (x - x0) END) * f.v), 6) AS v FROM k, o JOIN field f ON f.plane = k.plane AND f.j = y0 + a AND f.i = x0 + b GROUP BY 1, 2, 3""")
def advected_field(spark: SparkSession, sf: str) -> DataFrame:
    return X.advect(field(spark, sf), ["plane"], "v", 1.25, -0.5, NY, NX).select("plane", "j", "i", *r6("v"))


@query(f"""WITH n AS (SELECT user_id AS member, CAST(ceil(epoch_us(ts) / 3600000000.0) AS BIGINT) AS t, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS c FROM events WHERE event_type <> 'view' GROUP BY 1, 2),
d AS (SELECT user_id % 5 AS donor, CAST(ceil(epoch_us(ts) / 3600000000.0) AS BIGINT) AS t, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS c FROM events WHERE event_type = 'view' GROUP BY 1, 2),
w AS (SELECT *, t % 6 AS lead, CAST(0.5 AS DOUBLE) * (1 + cos(pi() * least(greatest((t % 6 - 1) / CAST(3 AS DOUBLE), 0), 1))) AS w FROM n)
SELECT member, w.t, lead, round(coalesce(w * w.c + (1 - w) * d.c, w.c), 4) AS c FROM w LEFT JOIN d ON d.donor = member % 5 AND d.t = w.t""")
def blended_members(spark: SparkSession, sf: str) -> DataFrame:
    """Every user is a member, with all events but views; the views of each fifth of the users are a donor."""
    e = table(spark, sf, "events").select("user_id", "event_type", step_end(F.col("ts")).alias("t"), cents("value").alias("c"))
    total = F.sum("c").cast("double").alias("c")
    n = e.where("event_type <> 'view'").groupBy(F.col("user_id").alias("member"), "t").agg(total)
    d = e.where("event_type = 'view'").groupBy((F.col("user_id") % 5).alias("donor"), "t").agg(total)
    out = X.blend_members(n, d, 5, blend_weight((F.col("t") % 6).cast("double")), "c", ["t"])
    return out.select("member", "t", (F.col("t") % 6).alias("lead"), F.round("c", 4).alias("c"))
