"""Queries from scenarios to warning levels, and those that a reader of the product asks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import ensemble as E
from tessera.operators import windows as W
from tessera.operators.weighted import quantiles_of_all
from tessera.plans.catalogue import hourly_sql, query, r6, table

#: Members and their weights, thresholds (cents in 1 and 12 hours) of the levels 2 to 5, and decision thresholds.
MEMBERS = {"view": 3.0, "click": 2.0, "purchase": 1.0, "signup": 1.0, "error": 1.0}
THRESHOLDS = {2: (2000.0, 6000.0), 3: (5000.0, 12000.0), 4: (12000.0, 25000.0), 5: (24000.0, 50000.0)}
TAU = {2: 0.15, 3: 0.30, 4: 0.30, 5: 0.40}
SIGMA, BIAS, CAP = 0.6, 1.1, 4
#: Coefficients of the flood vote: intercept, log ratio, log ratio now, log depth. Fixed values.
FLOOD_BETA = (-6.768986374145211, 0.5866359895714746, 0.898469750909088, 0.8373875301101608)

MEMBER_VALUES = ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in MEMBERS.items())
LEVEL_VALUES = ", ".join(f"({k}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for k, (a, b) in THRESHOLDS.items())
TAU_VALUES = ", ".join(f"({k}, CAST({v} AS DOUBLE))" for k, v in TAU.items())


def phi_sql(x: str) -> str:
    t = f"(1 / (1 + CAST(0.3275911 AS DOUBLE) * (abs({x}) / CAST(1.4142135623730951 AS DOUBLE))))"
    poly = f"(((((CAST(1.061405429 AS DOUBLE) * {t} - CAST(1.453152027 AS DOUBLE)) * {t} + CAST(1.421413741 AS DOUBLE)) * {t} - CAST(0.284496736 AS DOUBLE)) * {t} + CAST(0.254829592 AS DOUBLE)) * {t})"
    return f"(CAST(0.5 AS DOUBLE) * (1 + sign({x}) * (1 - {poly} * exp(-({x}) * ({x}) / 2))))"


def dress_sql(ratio: str) -> str:
    return phi_sql(f"(ln(greatest(CAST({BIAS} AS DOUBLE) * ({ratio}), CAST(1e-9 AS DOUBLE))) / CAST({SIGMA} AS DOUBLE))")


AMOUNTS = f"""{hourly_sql().replace('SELECT user_id AS s', 'SELECT user_id % 40 AS cell, event_type AS member').replace('GROUP BY 1, 2', 'GROUP BY 1, 2, 3')},
rolled AS (SELECT *, sum(c) OVER (PARTITION BY cell, member ORDER BY t RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS a FROM hourly),
amounts AS (SELECT cell, (t - 1) // 24 AS f, member, CAST(max(c) AS DOUBLE) AS a1, CAST(max(a) AS DOUBLE) AS a12 FROM rolled GROUP BY 1, 2, 3)"""
PROBS = f"""{AMOUNTS}, m(member, w) AS (VALUES {MEMBER_VALUES}), l(level, t1, t12) AS (VALUES {LEVEL_VALUES}),
x AS (SELECT cell, f, level, w, {dress_sql('a1 / t1')} AS p1, {dress_sql('a12 / t12')} AS p12 FROM amounts JOIN m USING (member), l),
raw AS (SELECT cell, f, level, sum(w * greatest(p1, p12)) / sum(w) AS raw, sum(w * p1) / sum(w) AS raw1 FROM x GROUP BY 1, 2, 3),
probs AS (SELECT cell, f, level, min(raw) OVER v AS p, min(raw1) OVER v AS p1 FROM raw WINDOW v AS (PARTITION BY cell, f ORDER BY level)),
tau(level, need) AS (VALUES {TAU_VALUES}),
decided AS (SELECT cell, f, CAST(least(coalesce(max(CASE WHEN p >= need THEN level END), 1), {CAP}) AS INT) AS decided, max(p) AS p_top FROM probs JOIN tau USING (level) GROUP BY 1, 2)"""


def amounts(spark: SparkSession, sf: str) -> DataFrame:
    """cell, f (day), member, w, a1, a12 in cents."""
    e = table(spark, sf, "events")
    h = e.groupBy((F.col("user_id") % 40).alias("cell"), F.col("event_type").alias("member"), W.step_end(F.col("ts")).alias("t")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("c"))
    rolled = W.trailing(h, ["cell", "member"], "c", 12, "a")
    out = rolled.groupBy("cell", F.floor((F.col("t") - 1) / 24).alias("f"), "member").agg(F.max("c").cast("double").alias("a1"), F.max("a").cast("double").alias("a12"))
    weight = F.element_at(F.create_map(*[x for k, v in MEMBERS.items() for x in (F.lit(k), F.lit(v))]), F.col("member"))
    return out.withColumn("w", weight)


def probabilities(spark: SparkSession, sf: str) -> DataFrame:
    return E.probabilities(amounts(spark, sf), ["cell", "f"], THRESHOLDS, SIGMA, BIAS)


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    return E.decide(probabilities(spark, sf), ["cell", "f"], TAU, CAP)


@query(f"WITH {PROBS} SELECT cell, f, level, round(p, 6) AS p, round(p1, 6) AS p1 FROM probs")
def dressed_probability_level(spark: SparkSession, sf: str) -> DataFrame:
    return probabilities(spark, sf).select("cell", "f", "level", *r6("p", "p1"))


@query(f"WITH {PROBS} SELECT cell, f, decided, round(p_top, 6) AS p_top FROM decided")
def decide_cap(spark: SparkSession, sf: str) -> DataFrame:
    return decisions(spark, sf).select("cell", "f", "decided", *r6("p_top"))


VOTES = f"""votes AS (SELECT cell, f, member AS model, CASE WHEN a12 >= 50000 THEN 5 WHEN a12 >= 25000 THEN 4 WHEN a12 >= 12000 THEN 3 ELSE 1 END AS level, CAST(1 AS DOUBLE) AS w FROM amounts),
bym AS (SELECT cell, f, model, CAST(sum(CASE WHEN level >= 4 THEN w ELSE 0 END) > CASE WHEN model = 'view' THEN CAST(0.3 AS DOUBLE) * sum(w) - CAST(1e-12 AS DOUBLE) ELSE 0 END AS INT) AS v4, CAST(sum(CASE WHEN level >= 5 THEN w ELSE 0 END) > CASE WHEN model = 'view' THEN CAST(0.3 AS DOUBLE) * sum(w) - CAST(1e-12 AS DOUBLE) ELSE 0 END AS INT) AS v5 FROM votes GROUP BY 1, 2, 3),
agreed AS (SELECT cell, f, CAST(CASE WHEN sum(v5) >= 2 THEN 5 WHEN sum(v4) >= 2 THEN 4 ELSE 0 END AS INT) AS agreed FROM bym GROUP BY 1, 2)"""


def agreed(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("a12")
    level = F.when(a >= 50000, 5).when(a >= 25000, 4).when(a >= 12000, 3).otherwise(1)
    v = amounts(spark, sf).withColumn("level", level).withColumn("one", F.lit(1.0))
    return E.agreement(v, ["cell", "f"], "member", "level", "one", F.col("member") == "view")


@query(f"WITH {AMOUNTS}, {VOTES} SELECT cell, f, agreed FROM agreed")
def model_agreement_vote(spark: SparkSession, sf: str) -> DataFrame:
    return agreed(spark, sf)


@query(f"WITH {PROBS}, {VOTES} SELECT cell, f, CAST(CASE WHEN cell % 7 = 3 THEN 0 ELSE greatest(decided, agreed) END AS INT) AS final FROM decided JOIN agreed USING (cell, f)")
def decide_cap_agreement(spark: SparkSession, sf: str) -> DataFrame:
    both = decisions(spark, sf).join(agreed(spark, sf), ["cell", "f"])
    return both.select("cell", "f", E.apply_overrides(F.col("decided"), F.col("cell") % 7 != 3, F.col("agreed")).alias("final"))


@query(f"""WITH {hourly_sql('event_type')}, g AS (SELECT s, t, coalesce(sum(CASE WHEN t % 24 < 12 THEN c END) OVER w, 0) AS seen, coalesce(sum(CASE WHEN t % 24 >= 12 THEN c END) OVER w, 0) AS new FROM hourly WINDOW w AS (PARTITION BY s ORDER BY t RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)),
p AS (SELECT *, seen * least(greatest(new / CAST(5000 AS DOUBLE), 0), 1) AS part FROM g) SELECT s, t, round(part + new, 4) AS a12, round(CASE WHEN part + new > 0 THEN part / (part + new) ELSE 0 END, 6) AS phi FROM p""")
def observed_gate(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.plans.catalogue import hourly

    h = hourly(spark, sf, "event_type").withColumn("observed", F.col("t") % 24 < 12)
    return E.observed_gate(h, ["s"], "c", "observed", 5000.0).select("s", "t", F.round("a12", 4).alias("a12"), *r6("phi"))


@query(f"""WITH {AMOUNTS} SELECT cell, f, round(quantile_cont(a12, 0.1), 4) AS p10, round(quantile_cont(a12, 0.5), 4) AS p50, round(quantile_cont(a12, 0.9), 4) AS p90 FROM amounts GROUP BY 1, 2""")
def member_spread(spark: SparkSession, sf: str) -> DataFrame:
    return E.spread_to_members(amounts(spark, sf), ["cell", "f"], "a12").select("cell", "f", *[F.round(c, 4).alias(c) for c in ("p10", "p50", "p90")])


@query(f"""WITH {PROBS}, z AS (SELECT cell % 8 AS zone, f, max(decided) AS zl FROM decided WHERE cell % 8 < 5 GROUP BY 1, 2) SELECT d.cell, d.f, d.cell % 8 AS zone, coalesce(z.zl, d.decided) AS decided FROM decided d LEFT JOIN z ON d.cell % 8 = z.zone AND d.f = z.f""")
def zone_day_overlay(spark: SparkSession, sf: str) -> DataFrame:
    d = decisions(spark, sf).withColumn("zone", F.col("cell") % 8).drop("p_top")
    zones = d.where("zone < 5").groupBy("zone", "f").agg(F.max("decided").alias("decided"))
    return E.overlay_zones(d, zones, "zone", ["f"], "decided")


@query("""SELECT s_suppkey AS k, round(1 / (1 + exp(-(CAST(-1.2 AS DOUBLE) + CAST(0.8 AS DOUBLE) * (s_acctbal - 4000) / 3000 + CAST(0.5 AS DOUBLE) * (s_nationkey - 12) / 7))), 6) AS p FROM supplier""")
def zone_day_logistic(spark: SparkSession, sf: str) -> DataFrame:
    f = {"balance": F.col("s_acctbal"), "nation": F.col("s_nationkey")}
    p = E.zone_day(f, {"balance": (0.8, 4000.0, 3000.0), "nation": (0.5, 12.0, 7.0)}, -1.2)
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.round(p, 6).alias("p"))


EFI = """WITH q AS (SELECT quantile_cont(l_quantity, [CAST(0.1 AS DOUBLE), CAST(0.3 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.7 AS DOUBLE), CAST(0.9 AS DOUBLE)]) AS qs FROM lineitem),
c AS (SELECT qs[i] AS q, [CAST(0.1 AS DOUBLE), CAST(0.3 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.7 AS DOUBLE), CAST(0.9 AS DOUBLE)][i] AS p FROM q, range(1, 6) x(i)),
f AS (SELECT l_suppkey AS k, p, (p - avg(CASE WHEN l_quantity <= q THEN CAST(1 AS DOUBLE) ELSE 0 END)) / sqrt(p * (1 - p)) AS y FROM lineitem, c GROUP BY 1, 2),
d AS (SELECT k, (y + lead(y) OVER w) / 2 * (lead(p) OVER w - p) * 2 / pi() AS part FROM f WINDOW w AS (PARTITION BY k ORDER BY p)) SELECT k, round(least(greatest(sum(part), -1), 1), 6) AS efi FROM d GROUP BY k"""


EFI_LEVELS = [0.1, 0.3, 0.5, 0.7, 0.9]


def climate(li: DataFrame) -> DataFrame:
    """Quantiles of all rows, for each key."""
    levels = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in zip(EFI_LEVELS, quantiles_of_all(li, "v", EFI_LEVELS), strict=True)]))
    return li.select("k").distinct().withColumn("x", levels).select("k", "x.p", "x.q")


@query(EFI)
def efi_index(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("v"))
    return E.forecast_index(li, climate(li), ["k"], "v").select("k", *r6("efi"))


@query(EFI.split(", f AS")[0].rstrip(",\n").split("f AS (SELECT")[0].rstrip().rstrip(",") + """,
f AS (SELECT l_suppkey AS k, p, any_value(q) AS q, avg(CASE WHEN l_quantity <= q THEN CAST(1 AS DOUBLE) ELSE 0 END) AS f FROM lineitem, c GROUP BY 1, 2),
g AS (SELECT k, p, q, f FROM f UNION ALL SELECT k, 0, arg_min(q, p), arg_min(f, p) FROM f GROUP BY k UNION ALL SELECT k, 1, arg_max(q, p), arg_max(f, p) FROM f GROUP BY k),
h AS (SELECT *, asin(sqrt(p)) AS x, sqrt(p * (1 - p)) AS r FROM g), d AS (SELECT *, lead(p) OVER w AS p2, lead(q) OVER w AS q2, lead(f) OVER w AS f2, lead(x) OVER w - x AS dx, lead(r) OVER w - r AS dr FROM h WINDOW w AS (PARTITION BY k ORDER BY p))
SELECT k, round(least(greatest(sum(CASE WHEN q2 > 20 THEN (1 - 2 * f) * dx - dr + (f2 - f) / (p2 - p) * ((2 * p - 1) * dx + dr) END) / sum(CASE WHEN q2 > 20 THEN dx - dr END), -1), 1), 6) AS efi FROM d WHERE p2 IS NOT NULL GROUP BY k""")
def efi_closed_form(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("v"))
    return E.closed_forecast_index(li, climate(li), ["k"], "v", wet=20.0).select("k", *r6("efi"))


@query("""WITH c AS (SELECT quantile_cont(l_quantity, CAST(0.9 AS DOUBLE)) AS cp, quantile_cont(l_quantity, CAST(0.99 AS DOUBLE)) AS ct FROM lineitem), q AS (SELECT l_suppkey AS k, quantile_cont(l_quantity, CAST(0.9 AS DOUBLE)) AS q FROM lineitem GROUP BY 1)
SELECT k, round((q - ct) / greatest(ct - cp, CAST(0.5 AS DOUBLE)), 6) AS sot FROM q, c""")
def shift_of_tails(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("v"))
    p, top = quantiles_of_all(li, "v", [0.9, 0.99])
    tails = li.select("k").distinct().withColumns({"c_p": F.lit(p), "c_top": F.lit(top)})
    return E.shift_of_tails(li, tails, ["k"], "v").select("k", *r6("sot"))


@query(f"WITH {PROBS}, r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY decided DESC, round(p_top, 6) DESC, f) AS k FROM decided) SELECT cell, f, decided, round(p_top, 6) AS p_top FROM r WHERE k = 1")
def worst_frame_argmax(spark: SparkSession, sf: str) -> DataFrame:
    return E.worst(decisions(spark, sf).withColumn("p_top", F.round("p_top", 6)), ["cell"], "decided", "p_top", "f")


@query(f"""WITH {PROBS}, n AS (SELECT decided AS level, count(DISTINCT cell) AS cells, min(f) AS first, max(f) AS last FROM decided GROUP BY 1) SELECT level, cells, first, last FROM n WHERE level = (SELECT max(level) FROM n)""")
def headline_top_level(spark: SparkSession, sf: str) -> DataFrame:
    n = decisions(spark, sf).groupBy(F.col("decided").alias("level")).agg(F.count_distinct("cell").alias("cells"), F.min("f").alias("first"), F.max("f").alias("last"))
    return n.orderBy(F.desc("level")).limit(1)


@query(f"""WITH {PROBS}, z AS (SELECT cell % 8 AS zone, max(decided) AS level, count(*) FILTER (WHERE decided >= 3) AS frames FROM decided GROUP BY 1), o AS (SELECT n_regionkey AS zone, count(*) AS warnings FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < -900 GROUP BY 1)
SELECT coalesce(z.zone, o.zone) AS zone, level, frames, warnings FROM z FULL JOIN o ON z.zone = o.zone""")
def zone_summary_outer(spark: SparkSession, sf: str) -> DataFrame:
    z = decisions(spark, sf).groupBy((F.col("cell") % 8).alias("zone")).agg(F.max("decided").alias("level"), F.count(F.when(F.col("decided") >= 3, 1)).alias("frames"))
    c = table(spark, sf, "customer").where("c_acctbal < -900").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return z.join(c.groupBy(F.col("n_regionkey").cast("long").alias("zone")).agg(F.count("*").alias("warnings")), "zone", "full")


@query(f"""WITH {PROBS}, i AS (SELECT cell, f, decided >= 3 AS on_, f - row_number() OVER (PARTITION BY cell, decided >= 3 ORDER BY f) AS k FROM decided), r AS (SELECT cell, min(f) AS f0, max(f) AS f1 FROM i WHERE on_ GROUP BY cell, k)
SELECT cell, min(f0) AS f0, arg_min(f1, f0) AS f1 FROM r GROUP BY cell""")
def first_warning_period(spark: SparkSession, sf: str) -> DataFrame:
    d = decisions(spark, sf).select("cell", F.col("f").alias("t"), (F.col("decided") >= 3).alias("on_"))
    runs = W.level_runs(d, ["cell"], "on_").where("on_")
    return runs.groupBy("cell").agg(F.min("t0").alias("f0"), F.min_by("t1", "t0").alias("f1"))


@query("""WITH p AS (SELECT p_partkey, p_name, p_retailprice, CASE WHEN lower(p_name) = 'red' THEN 0 WHEN lower(p_name) LIKE 'red%' THEN 1 WHEN lower(p_name) LIKE '% red%' THEN 2 WHEN lower(p_name) LIKE '%red%' THEN 3 END AS rank FROM part)
SELECT p_partkey, p_name, rank FROM p WHERE rank IS NOT NULL ORDER BY rank, p_retailprice DESC, p_partkey LIMIT 8""")
def place_search_rank(spark: SparkSession, sf: str) -> DataFrame:
    name, q = S.fold_text(F.col("p_name")), "red"
    rank = F.when(name == q, 0).when(name.startswith(q), 1).when(name.contains(" " + q), 2).when(name.contains(q), 3)
    hits = table(spark, sf, "part").withColumn("rank", rank).where("rank is not null")
    return hits.orderBy("rank", F.desc("p_retailprice"), "p_partkey").limit(8).select("p_partkey", "p_name", "rank")


@query("SELECT c_custkey AS id, c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer ORDER BY place LIMIT 40")
def top_40(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(40)
    return c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("place"))


@query(f"""WITH {PROBS}, vx AS (SELECT cell, f, p_top * 50 AS peak, decided * CAST(9 AS DOUBLE) AS pot, CASE WHEN cell % 10 > 0 THEN CAST(30 + cell AS DOUBLE) END AS t, decided * CAST(20 AS DOUBLE) AS depth, CAST(0.5 AS DOUBLE) * pow((20 + cell * CAST(15 AS DOUBLE)) / 184, CAST(0.75 AS DOUBLE)) AS few FROM decided)
SELECT cell, f, round(CASE WHEN t > 0 THEN 1 / (1 + exp(-({FLOOD_BETA[0]!r} + {FLOOD_BETA[1]!r} * ln((peak + few) / t) + {FLOOD_BETA[2]!r} * ln((pot + few) / t) + {FLOOD_BETA[3]!r} * ln(1 + depth)))) ELSE 0 END, 6) AS vote FROM vx""")
def flood_vote(spark: SparkSession, sf: str) -> DataFrame:
    d, cell = decisions(spark, sf), F.col("cell")
    v = E.flood_vote(F.col("p_top") * 50, F.col("decided") * 9.0, F.when(cell % 10 > 0, (30 + cell).cast("double")), 20 + cell * 15.0, F.col("decided") * 20.0, FLOOD_BETA)
    return d.select("cell", "f", F.round(v, 6).alias("vote"))


@query("""SELECT l_orderkey % 500 AS k, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS r, max(CASE WHEN l_linenumber <= 2 THEN l_quantity END) AS q1, max(CASE WHEN l_linenumber > 2 THEN l_quantity END) AS q12 FROM lineitem GROUP BY 1""")
def conditional_maxima(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy((F.col("l_orderkey") % 500).alias("k")).agg(
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("r"), F.max(F.when(F.col("l_linenumber") <= 2, F.col("l_quantity"))).alias("q1"), F.max(F.when(F.col("l_linenumber") > 2, F.col("l_quantity"))).alias("q12")
    )
