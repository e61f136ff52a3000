"""Queries on time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import windows as W
from tessera.plans.catalogue import START, cents, hourly, hourly_sql, query, r6, table

H = f"WITH {hourly_sql()}"


#: Hourly sums of each user, views and clicks apart from the rest.
SIDES = """sides AS (SELECT user_id AS k, CAST(ceil(epoch_us(ts) / 3600000000.0) AS BIGINT) AS t, event_type IN ('view', 'click') AS own, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS c FROM events GROUP BY 1, 2, 3)"""


def sides(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("own", F.col("event_type").isin("view", "click"))
    return e.groupBy(F.col("user_id").alias("k"), W.step_end(F.col("ts")).alias("t"), "own").agg(F.sum(cents("value")).cast("double").alias("c"))


@query(f"{H} SELECT s, t, CAST(sum(c) OVER (PARTITION BY s ORDER BY t RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS BIGINT) AS a12 FROM hourly")
def trailing_12h_sum(spark: SparkSession, sf: str) -> DataFrame:
    return W.trailing(hourly(spark, sf), ["s"], "c", 12, "a12").select("s", "t", "a12")


@query(f"""{H}, w AS (SELECT s, t, sum(c) OVER x AS v, count(*) OVER x AS k, t - min(t) OVER (PARTITION BY s) AS age FROM hourly WINDOW x AS (PARTITION BY s ORDER BY t RANGE BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT s, t, CAST(CASE WHEN age >= 5 AND k >= 2 THEN v END AS BIGINT) AS a6 FROM w""")
def strict_trailing_sum(spark: SparkSession, sf: str) -> DataFrame:
    return W.trailing(hourly(spark, sf), ["s"], "c", 6, "a6", strict=True, least=2).select("s", "t", "a6")


@query("""SELECT event_type AS s, CAST(ceil(epoch_us(ts) / 3600000000.0) AS BIGINT) AS t, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total,
CAST(max(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS top, arg_max(CAST(round(value * 100) AS BIGINT), ts) AS last FROM events GROUP BY 1, 2""")
def hour_end_resample(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("s"), "ts", cents("value").alias("v"))
    return W.resample(e, ["s"], "ts", "v").drop("mean")


@query("""SELECT event_type AS s, CAST(ceil(epoch_us(ts) / 3600000000.0) AS BIGINT) AS t, count(*) AS n, round(sum(CAST(round(value * 100) AS BIGINT)) * 4 / CAST(count(*) AS DOUBLE), 6) AS total
FROM events GROUP BY 1, 2 HAVING count(*) >= 3""")
def incomplete_hour_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("s"), "ts", cents("value").alias("v"))
    return W.complete_steps(e, ["s"], "ts", "v", 4, 3).withColumn("total", F.round("total", 6))


@query(f"""WITH {hourly_sql('event_type')}, w AS (SELECT s, t, sum(c) OVER x AS v, count(*) OVER x AS k FROM hourly WINDOW x AS (PARTITION BY s ORDER BY t RANGE BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT s, t, CAST(CASE WHEN k >= 8 THEN v END AS BIGINT) AS a10 FROM w""")
def gauge_acc_80pct(spark: SparkSession, sf: str) -> DataFrame:
    return W.trailing(hourly(spark, sf, "event_type"), ["s"], "c", 10, "a10", least=8).select("s", "t", "a10")


FRAMES = f"""frames AS (
SELECT 'now' AS horizon, CAST(f AS INT) AS f, {START} + f AS t0, {START} + f + 1 AS t1 FROM range(6) x(f)
UNION ALL SELECT 'mid', CAST(f AS INT), ({START} + 6) // 3 * 3 + 3 * f, ({START} + 6) // 3 * 3 + 3 * f + 3 FROM range(14) x(f)
UNION ALL SELECT 'long', CAST(f AS INT), {START} // 24 * 24 + 24 * (f + 2), {START} // 24 * 24 + 24 * (f + 3) FROM range(6) x(f))"""


@query(f"""WITH {hourly_sql('event_type')}, {FRAMES}, r AS (SELECT *, sum(c) OVER (PARTITION BY s ORDER BY t RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS a FROM hourly)
SELECT s, horizon, f, CAST(max(c) AS BIGINT) AS a1, CAST(max(a) AS BIGINT) AS a12, count(*) AS n FROM r JOIN frames ON t > t0 AND t <= t1 GROUP BY s, horizon, f, t0, t1
HAVING count(*) >= greatest(1, floor(0.75 * (t1 - t0)))""")
def frame_max_right_closed(spark: SparkSession, sf: str) -> DataFrame:
    return W.frame_amounts(hourly(spark, sf, "event_type"), ["s"], W.frames(spark, START), "c").drop("t0", "t1")


@query(f"""{H}, d AS (SELECT s, t, least(coalesce(t - lag(t) OVER w, 1), 6) AS gap, greatest(c - coalesce(lag(c) OVER w, 0), 0) AS amount FROM hourly WINDOW w AS (PARTITION BY s ORDER BY t))
SELECT s, t - k AS t, round(amount / CAST(gap AS DOUBLE), 6) AS c FROM d, range(6) x(k) WHERE k < gap""")
def deaccumulate_spread(spark: SparkSession, sf: str) -> DataFrame:
    return W.spread_accumulations(hourly(spark, sf), ["s"], "c", since_start=True).select("s", "t", F.round("c", 6).alias("c"))


@query(f"""{H}, d AS (SELECT s, t, c, t - lag(t) OVER (PARTITION BY s ORDER BY t) AS step FROM hourly), m AS (SELECT *, min(step) OVER (PARTITION BY s ORDER BY t) AS least FROM d),
f AS (SELECT *, max(CASE WHEN step > least THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY t) AS seen FROM m) SELECT s, t, c FROM f WHERE seen = 0""")
def finest_step_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return W.finest_part(hourly(spark, sf).select("s", "t", "c"), ["s"])


@query(f"""{H} SELECT a.s, a.t, a.c - coalesce(b.c, 0) AS change FROM hourly a LEFT JOIN hourly b ON a.s = b.s AND b.t = a.t - (a.s % 5 + 1)""")
def variable_lag_diff(spark: SparkSession, sf: str) -> DataFrame:
    h = hourly(spark, sf).withColumn("lag", F.col("s") % 5 + 1)
    back = h.select("s", "t", F.col("c").alias("c"), "lag")
    return W.lagged_difference(back, ["s"], "c", "lag", "change").select("s", "t", F.col("change").cast("long").alias("change"))


@query("""WITH e AS (SELECT user_id AS s, epoch_us(ts) // 1000000 AS t, CAST(round(value * 100) AS DOUBLE) AS v FROM events), g AS (SELECT s, t, max(v) AS v FROM e GROUP BY 1, 2),
p AS (SELECT s, t, v, lead(v) OVER w AS v2, lead(t) OVER w AS t2 FROM g WINDOW w AS (PARTITION BY s ORDER BY t))
SELECT s, round(sum(coalesce((v + v2) / 2, v) * CASE WHEN t2 - t <= 7200 THEN t2 - t END / 3600.0), 4) AS amount, CAST(sum(CASE WHEN t2 - t <= 7200 THEN t2 - t END) AS BIGINT) AS covered, max(t) - min(t) AS of FROM p GROUP BY s""")
def trapezoid_accumulate(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("s"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t"), cents("value").cast("double").alias("v"))
    out = W.trapezoid(e.groupBy("s", "t").agg(F.max("v").alias("v")), ["s"], "v", 7200)
    return out.select("s", F.round("amount", 4).alias("amount"), F.col("covered").cast("long").alias("covered"), "of")


@query(f"{H} SELECT s, CAST(u AS DOUBLE) AS rung, round(sum(greatest(c - u, 0) * CAST(0.25 AS DOUBLE)), 6) AS excess FROM hourly, (VALUES (0), (1000), (5000), (20000)) r(u) GROUP BY s, u")
def burst_ladder_excess(spark: SparkSession, sf: str) -> DataFrame:
    return W.ladder_excess(hourly(spark, sf), ["s"], "c", [0, 1000, 5000, 20000], 0.25).withColumn("excess", F.round("excess", 6))


@query(f"""{H}, k AS (SELECT s, s % 10 AS g, t, sum(c) OVER (PARTITION BY s ORDER BY t DESC) AS x FROM hourly), m AS (SELECT g, t, max(x) AS top FROM k GROUP BY 1, 2)
SELECT g, t, CAST(top AS BIGINT) AS top, CAST(top - coalesce(lag(top) OVER (PARTITION BY g ORDER BY t DESC), 0) AS BIGINT) AS increment FROM m""")
def telescoped_increments(spark: SparkSession, sf: str) -> DataFrame:
    h = hourly(spark, sf).withColumn("g", F.col("s") % 10)
    return W.telescoped(h, ["s"], ["g"], "c").select("g", "t", "top", F.col("increment").cast("long").alias("increment"))


@query(f"""{H}, l AS (SELECT s, max(t) AS t1, arg_max(c, t) AS v1 FROM hourly GROUP BY s), o AS (SELECT h.s, max(h.t) AS t0, arg_max(h.c, h.t) AS v0 FROM hourly h JOIN l ON h.s = l.s AND h.t <= l.t1 - 3 GROUP BY h.s)
SELECT l.s, l.t1, o.t0, round((v1 - v0) / CAST(t1 - t0 AS DOUBLE), 6) AS rate FROM l LEFT JOIN o ON l.s = o.s""")
def rate_of_change_3h(spark: SparkSession, sf: str) -> DataFrame:
    return W.rate_of_change(hourly(spark, sf), ["s"], "c", 3, 1).select("s", "t1", "t0", F.round("rate", 6).alias("rate"))


@query(f"""{H}, w AS (SELECT s, t, c, lag(c) OVER x AS a, lead(c) OVER x AS b FROM hourly WINDOW x AS (PARTITION BY s ORDER BY t))
SELECT s, t, CAST(CASE WHEN a IS NULL OR b IS NULL THEN c ELSE a + b + c - greatest(a, b, c) - least(a, b, c) END AS DOUBLE) AS middle FROM w""")
def median3_filter(spark: SparkSession, sf: str) -> DataFrame:
    h = hourly(spark, sf).withColumn("c", F.col("c").cast("double"))
    return W.median3(h, ["s"], "c", "middle").select("s", "t", "middle")


@query(f"{H} SELECT s, t, round(avg(c) OVER (PARTITION BY s ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean FROM hourly")
def moving_mean_5(spark: SparkSession, sf: str) -> DataFrame:
    return W.moving_mean(hourly(spark, sf), ["s"], "c", 2, "mean").select("s", "t", *r6("mean"))


@query(f"""{H}, d AS (SELECT s, t, c, CASE WHEN t - lag(t) OVER (PARTITION BY s ORDER BY t) > 12 THEN 1 ELSE 0 END AS new FROM hourly WHERE c > 500), e AS (SELECT *, sum(new) OVER (PARTITION BY s ORDER BY t) AS event FROM d)
SELECT s, CAST(event AS BIGINT) AS event, min(t) AS t0, max(t) AS t1, count(*) AS steps, CAST(sum(c) AS BIGINT) AS total, CAST(max(c) AS BIGINT) AS peak, (array_agg(t ORDER BY c DESC, t))[1] AS t_peak
FROM e GROUP BY s, event HAVING sum(c) >= 2000""")
def gaps_islands_events(spark: SparkSession, sf: str) -> DataFrame:
    return W.events(hourly(spark, sf), ["s"], F.col("c") > 500, "c", 12, 2000.0)


@query(f"""{H}, d AS (SELECT s AS g, s, t AS a, t + n * 6 AS b FROM hourly), o AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY g ORDER BY a, b, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM d),
e AS (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY a, b, s ROWS UNBOUNDED PRECEDING) AS episode FROM o) SELECT g, CAST(episode AS BIGINT) AS episode, min(a) AS a, max(b) AS b, count(*) AS n FROM e GROUP BY g, episode""")
def interval_merge_episodes(spark: SparkSession, sf: str) -> DataFrame:
    d = hourly(spark, sf).select(F.col("s").alias("g"), F.col("t").alias("a"), (F.col("t") + F.col("n") * 6).alias("b"))
    return W.merge_intervals(d, ["g"], "a", "b").groupBy("g", "episode").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("n"))


@query(f"""WITH {hourly_sql('event_type')}, l AS (SELECT s, t, CAST(least(n, 3) AS INT) AS level FROM hourly), i AS (SELECT *, t - row_number() OVER (PARTITION BY s, level ORDER BY t) AS k FROM l)
SELECT s, level, min(t) AS t0, max(t) AS t1, count(*) AS steps FROM i GROUP BY s, level, k""")
def level_runs(spark: SparkSession, sf: str) -> DataFrame:
    h = hourly(spark, sf, "event_type").withColumn("level", F.least("n", F.lit(3)).cast("int"))
    return W.level_runs(h, ["s"], "level")


@query(f"{H} SELECT s, min(CASE WHEN c >= 1000 THEN t END) AS t_0, min(CASE WHEN c >= 10000 THEN t END) AS t_1, min(CASE WHEN c >= 40000 THEN t END) AS t_2 FROM hourly GROUP BY s")
def first_crossing(spark: SparkSession, sf: str) -> DataFrame:
    return W.first_crossing(hourly(spark, sf), ["s"], "c", [1000, 10000, 40000])


@query("""SELECT c_nationkey AS s, CAST(year(o_orderdate) AS INT) AS year, CAST(max(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS top, (array_agg(o_orderkey ORDER BY CAST(round(o_totalprice * 100) AS BIGINT) DESC, o_orderkey))[1] AS t_top, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def annual_max_argmax(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(F.col("c_nationkey").alias("s"), F.col("o_orderkey").alias("t"), cents("o_totalprice").alias("v"), F.year("o_orderdate").alias("y"))
    return W.yearly_maxima(rows, ["s"], F.col("y"), "v")


@query(f"""WITH {SIDES}, z AS (SELECT k // 15 AS k, t, own, sum(c) AS c FROM sides GROUP BY 1, 2, 3), p AS (SELECT a.k, g AS lag, corr(a.c, b.c) AS r FROM z a, range(-6, 7) x(g), z b WHERE a.own AND NOT b.own AND a.k = b.k AND b.t = a.t + g GROUP BY 1, 2 HAVING count(*) > 6)
SELECT k, (array_agg(CAST(lag AS INT) ORDER BY round(r, 9) DESC, abs(lag), lag))[1] AS lag, round(max(r), 6) AS r FROM p WHERE NOT isnan(r) GROUP BY k""")
def lag_by_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Of fifteen users together, by how many hours other events follow views and clicks."""
    h = sides(spark, sf).groupBy(F.floor(F.col("k") / 15).alias("k"), "t", "own").agg(F.sum("c").alias("c"))
    return W.best_lag(h.where("own").select("k", "t", F.col("c").alias("x")), h.where("not own").select("k", "t", F.col("c").alias("y")), ["k"], range(-6, 7)).select("k", "lag", *r6("r"))


@query(f"""WITH {SIDES}, rows AS (SELECT k, t, c, 0 AS r FROM sides WHERE own AND t <= {START} UNION ALL SELECT k, t, c, 1 FROM sides WHERE own AND t > {START} AND t % 5 > 0),
axis AS (SELECT k, unnest(range(min(t), max(t) + 1)) AS t FROM rows GROUP BY k), every AS (SELECT * FROM rows UNION ALL SELECT k, t, c, 2 FROM sides WHERE NOT own), have AS (SELECT k, t, (array_agg(c ORDER BY r))[1] AS c, min(r) AS r FROM every GROUP BY 1, 2)
SELECT a.k, a.t, coalesce(h.c, 0) AS c, CASE coalesce(r, 3) WHEN 0 THEN 'observed' WHEN 1 THEN 'forecast' WHEN 2 THEN 'bridge' ELSE 'none' END AS origin FROM axis a LEFT JOIN have h ON a.k = h.k AND a.t = h.t""")
def with_past_splice(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's views and clicks, whose forecast lacks every fifth hour, with other events as the bridge."""
    h = sides(spark, sf).select("own", "k", "t", "c")
    own, other = h.where("own").drop("own"), h.where("not own").drop("own")
    return W.splice(own, own.where("t % 5 > 0"), other, ["k"], START, "c")


@query(f"""WITH {hourly_sql('event_type')} SELECT a.s, a.t, round(sum(b.c * exp((b.t - a.t) / CAST(24 AS DOUBLE))), 4) AS api FROM hourly a JOIN hourly b ON a.s = b.s AND b.t BETWEEN a.t - 665 AND a.t GROUP BY a.s, a.t""")
def antecedent_index(spark: SparkSession, sf: str) -> DataFrame:
    return W.antecedent_index(hourly(spark, sf, "event_type"), ["s"], "c", 24.0, "api").select("s", "t", F.round("api", 4).alias("api"))


@query(f"""WITH RECURSIVE {hourly_sql()}, r AS (SELECT s, t, c, row_number() OVER (PARTITION BY s ORDER BY c DESC, t) AS k FROM hourly), g AS (SELECT s, CAST(1 AS BIGINT) AS k, [t] AS kept FROM r WHERE k = 1
UNION ALL SELECT r.s, r.k, CASE WHEN len(list_filter(kept, lambda x: abs(x - r.t) < 72)) = 0 THEN list_append(kept, r.t) ELSE kept END FROM g JOIN r ON r.s = g.s AND r.k = g.k + 1),
f AS (SELECT s, unnest(arg_max(kept, k)) AS t FROM g GROUP BY s) SELECT f.s, f.t, h.c FROM f JOIN hourly h ON h.s = f.s AND h.t = f.t""")
def decluster_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return W.decluster(hourly(spark, sf).select("s", "t", "c"), ["s"], "c", 72)


@query()
def despike_plateaus(spark: SparkSession, sf: str) -> DataFrame:
    return W.despike(hourly(spark, sf).select("s", "t", F.col("c").cast("double").alias("c")), ["s"], "c")
