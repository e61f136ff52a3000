"""Queries of the products of a cycle: catchments, zones, places on a river, plans of runs, causes of misses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import products as P
from tessera.operators import windows as W
from tessera.operators.ensemble import levels_of
from tessera.plans.catalogue import FIELD, START, cents, field, hourly, hourly_sql, query, r6, table
from tessera.plans.risk_queries import AMOUNTS, LEVEL_VALUES, MEMBER_VALUES, THRESHOLDS, amounts, phi_sql

NY, NX = 20, 10


@query(f"""WITH {FIELD}, o(variant, dj, di, share) AS (VALUES (0, 0, 0, CAST(0.4 AS DOUBLE)), (1, 2, 0, CAST(0.15 AS DOUBLE)), (2, -2, 0, CAST(0.15 AS DOUBLE)), (3, 0, 1, CAST(0.15 AS DOUBLE)), (4, 0, -1, CAST(0.15 AS DOUBLE)))
SELECT c.plane, c.j, c.i, n.v, variant, share FROM field c, o LEFT JOIN field n ON n.plane = c.plane AND n.j = least(greatest(c.j - dj, 0), {NY - 1}) AND n.i = least(greatest(c.i - di, 0), {NX - 1})""")
def displaced_members(spark: SparkSession, sf: str) -> DataFrame:
    return P.displaced(field(spark, sf), ["plane"], "v", 2, 1, NY, NX)


UNITS = 12
#: Unit u flows into (u - 1) // 2; areas in km2 and thresholds in mm of the levels 2 to 5.
AREAS = {u: 20.0 + 15.0 * u for u in range(UNITS)}
T1, T12 = [8.0, 16.0, 36.0, 54.0], [24.0, 40.0, 72.0, 120.0]


def _upstream(u: int) -> list[int]:
    return [u, *(x for k in (2 * u + 1, 2 * u + 2) if k < UNITS for x in _upstream(k))]


SHARES = [(u, x, AREAS[x] / sum(AREAS[y] for y in _upstream(u))) for u in range(UNITS) for x in _upstream(u)]
UP_AREA = {u: sum(AREAS[x] for x in _upstream(u)) for u in range(UNITS)}
C = P.Catchments(p0=12.0, s=40.0, a=0.35, b=0.45)
WEIGHTS = [("view", 3.0), ("click", 2.0), ("purchase", 1.0), ("signup", 1.0), ("error", 1.0)]
BIAS, SIGMA, DAYS, TAU = 1.15, 0.65, 31, (0.15, 0.3, 0.3, 0.4)


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _ratio_sql(o: str, f: str, k: int, area: str) -> str:
    parts = []
    for d in C.durations:
        limit = f"({_d(T1[k])} * pow({d}, ln({_d(T12[k])} / {_d(T1[k])}) / ln({_d(12.0)}))) * least(greatest(1 - log10(greatest({area}, 1)) / 15, {_d(0.5)}), 1)"
        parts.append(f"(least(greatest({f}{d} / {_d(C.gate)}, 0), 1) * {o}{d} + {_d(BIAS)} * {f}{d}) / ({limit})")
    return f"greatest({', '.join(parts)})"


_ROLLS = ", ".join(f"sum({x}) OVER (PARTITION BY m, u ORDER BY t RANGE BETWEEN {d - 1} PRECEDING AND CURRENT ROW) AS {x}{d}" for d in (*C.durations, 24) for x in ("o", "f", "p", "q"))
CATCHMENTS = f"""WITH raw AS (SELECT event_type AS m, user_id % {UNITS} AS u, CAST(ceil(epoch_us(ts) / 3600000000.0) AS BIGINT) AS t, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS c FROM events GROUP BY 1, 2, 3),
axis AS (SELECT m, u, t FROM (SELECT DISTINCT m FROM raw) a, range({UNITS}) b(u), (SELECT unnest(range(min(t), max(t) + 1)) AS t FROM raw) d),
own AS (SELECT a.m, a.u, a.t, CASE WHEN a.t % 24 < 12 THEN coalesce(c, 0) / {_d(3700.0)} ELSE 0 END AS o, CASE WHEN a.t % 24 < 12 THEN 0 ELSE coalesce(c, 0) / {_d(3700.0)} END AS f FROM axis a LEFT JOIN raw r ON a.m = r.m AND a.u = r.u AND a.t = r.t),
w(u, src, w) AS (VALUES {', '.join(f'({a}, {b}, {_d(x)})' for a, b, x in SHARES)}), un(u, area, up_area) AS (VALUES {', '.join(f'({u}, {_d(AREAS[u])}, {_d(UP_AREA[u])})' for u in range(UNITS))}),
ups AS (SELECT m, w.u, t, sum(w * o) AS p, sum(w * f) AS q FROM own JOIN w ON own.u = w.src GROUP BY 1, 2, 3), b AS (SELECT own.*, p, q, area, up_area, least(greatest({_d(C.a)} * pow(up_area, {_d(C.b)}), 1), {_d(C.slowest)}) AS tc FROM own JOIN ups USING (m, u, t) JOIN un USING (u)),
r AS (SELECT *, {_ROLLS} FROM b), s AS (SELECT *, CASE WHEN p24 + q24 > {_d(C.p0)} THEN pow(p24 + q24 - {_d(C.p0)}, 2) / (p24 + q24 - {_d(C.p0)} + {_d(C.s)}) ELSE 0 END AS e, q24 / greatest(p24 + q24, {_d(1e-9)}) AS sf, CAST(greatest(round_even(tc, 0), 1) AS BIGINT) AS lag,
{', '.join(f'{_ratio_sql("o", "f", k, "area")} AS a{k}, {_ratio_sql("p", "q", k, "up_area")} AS b{k}' for k in range(4))} FROM r),
d AS (SELECT s.*, greatest(s.e - coalesce(z.e, 0), 0) / s.lag * {_d(0.278)} AS uq FROM s LEFT JOIN s z ON z.m = s.m AND z.u = s.u AND z.t = s.t - s.lag),
g AS (SELECT *, uq / ({_d(C.fraction)} * {_d(C.envelope)} * pow(greatest(up_area, 1), {_d(C.exponent)})) * (1 + {_d(BIAS - 1)} * sf) AS rq FROM d), fr AS (SELECT f AS fr, {START} + 24 * f AS t0, {START} + 24 * f + 24 AS t1 FROM range({DAYS}) x(f)),
h AS (SELECT m, fr, u, {', '.join(f'max(CASE WHEN t > t0 THEN a{k} END) AS a{k}, max({f"greatest(b{k}, rq)" if k == 3 else f"b{k}"}) AS b{k}' for k in range(4))}, max(CASE WHEN t > t0 THEN o12 + f12 END) AS own12, max(CASE WHEN t > t0 THEN p12 + q12 END) AS up12, max(uq) AS q FROM g JOIN fr ON t > t0 - CAST(ceil(tc) AS BIGINT) AND t <= t1 GROUP BY 1, 2, 3),
ratios AS (SELECT m, fr AS f, u, {', '.join(f'greatest(a{k}, b{k}) AS r{k}' for k in range(4))}, own12, up12, q, b2 > a2 AS upstream FROM h WHERE own12 IS NOT NULL)"""


def catchment_ratios_of(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("m"), (F.col("user_id") % UNITS).alias("u"), W.step_end(F.col("ts")).alias("t")).agg(F.sum(cents("value")).alias("c"))
    ends = e.agg(F.min("t").alias("a"), F.max("t").alias("b"))  # one row
    axis = e.select("m").distinct().crossJoin(ends).select("m", F.explode(F.sequence("a", "b")).alias("t")).withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(UNITS - 1).cast("long"))))
    rain = F.coalesce("c", F.lit(0)) / 3700.0
    seen = F.col("t") % 24 < 12
    own = axis.join(e, ["m", "u", "t"], "left").select("m", "u", "t", F.when(seen, rain).otherwise(0.0).alias("o"), F.when(seen, 0.0).otherwise(rain).alias("f"))
    shares = F.broadcast(spark.createDataFrame(SHARES, "u long, src long, w double"))
    units = spark.createDataFrame([(u, AREAS[u], UP_AREA[u], T1, T12) for u in range(UNITS)], "u long, area double, up_area double, t1 array<double>, t12 array<double>")
    frames = spark.range(DAYS).select(F.col("id").alias("f"), (START + 24 * F.col("id")).alias("t0"), (START + 24 * F.col("id") + 24).alias("t1"))
    return P.catchment_ratios(own, shares, units, frames, ["m"], bias=BIAS, c=C)


@query(f"{CATCHMENTS} SELECT m, f, u, round(r0, 5) AS r2, round(r1, 5) AS r3, round(r2, 5) AS r4, round(r3, 5) AS r5, round(own12, 5) AS own12, round(up12, 5) AS up12, round(q, 6) AS q, CASE WHEN upstream THEN CAST(1 AS DOUBLE) ELSE 0 END AS upstream FROM ratios")
def catchment_ratios(spark: SparkSession, sf: str) -> DataFrame:
    out = catchment_ratios_of(spark, sf)
    return out.select("m", "f", "u", *[F.round(F.get("ratio", F.lit(k)), 5).alias(f"r{k + 2}") for k in range(4)], F.round("own12", 5).alias("own12"), F.round("up12", 5).alias("up12"), F.round("q", 6).alias("q"), "upstream")


def _quantile_sql(x: str) -> str:
    return f"{x}w AS (SELECT f, u, x, sum(w) OVER (PARTITION BY f, u ORDER BY x) / sum(w) OVER (PARTITION BY f, u) AS c FROM (SELECT f, u, {x} AS x, sum(w) AS w FROM k GROUP BY 1, 2, 3)), {x}q AS (SELECT f, u, min(CASE WHEN c >= {_d(0.5)} - 1e-9 THEN x END) AS {x}_50, min(CASE WHEN c >= {_d(0.9)} - 1e-9 THEN x END) AS {x}_90 FROM {x}w GROUP BY 1, 2)"


def _dressed(ratio: str, sigma: str, bias: str = "1") -> str:
    return phi_sql(f"(ln(greatest({bias} * ({ratio}), CAST(1e-9 AS DOUBLE))) / ({sigma}))")


@query(f"""{CATCHMENTS}, mw(m, w) AS (VALUES {', '.join(f"('{m}', {_d(x)})" for m, x in WEIGHTS)}), k AS (SELECT * FROM ratios JOIN mw USING (m)),
p AS (SELECT f, u, {', '.join(f'sum(w * {_dressed(f"r{j}", _d(SIGMA))}) / sum(w) AS p{j}' for j in range(4))}, sum(CASE WHEN upstream THEN w ELSE 0 END) / sum(w) AS upstream FROM k GROUP BY 1, 2),
n AS (SELECT f, u, upstream, p0 AS p2, least(p0, p1) AS p3, least(p0, p1, p2) AS p4, least(p0, p1, p2, p3) AS p5 FROM p), {_quantile_sql('own12')}, {_quantile_sql('up12')}, {_quantile_sql('q')}
SELECT f, u, {', '.join(f'round(p{j}, 5) AS p{j}' for j in range(2, 6))}, CAST(greatest(1, {', '.join(f'CASE WHEN p{j + 2} >= {_d(t)} THEN {j + 2} ELSE 1 END' for j, t in enumerate(TAU))}) AS INT) AS level, round(upstream, 6) AS upstream, round(own12_50, 5) AS own12_50, round(own12_90, 5) AS own12_90, round(up12_50, 5) AS up12_50, round(up12_90, 5) AS up12_90, round(q_50, 6) AS q_50, round(q_90, 6) AS q_90
FROM n JOIN own12q USING (f, u) JOIN up12q USING (f, u) JOIN qq USING (f, u)""")
def catchment_product(spark: SparkSession, sf: str) -> DataFrame:
    w = F.element_at(F.create_map(*[x for m, v in WEIGHTS for x in (F.lit(m), F.lit(v))]), F.col("m"))
    out = P.catchment_product(catchment_ratios_of(spark, sf).withColumn("w", w), "w", TAU, SIGMA)
    return out.select("f", "u", *[F.round(f"p{j}", 5).alias(f"p{j}") for j in range(2, 6)], "level", *r6("upstream"), *[F.round(f"{x}_{q}", d).alias(f"{x}_{q}") for x, d in (("own12", 5), ("up12", 5), ("q", 6)) for q in (50, 90)])


FAMILIES = {"view": (0.9, 1.1), "click": (1.2, 1.0), "purchase": (1.0, 1.0), "signup": (1.0, 0.8), "error": (1.1, 1.3)}
SCALED = f"""{AMOUNTS}, m(member, w) AS (VALUES {MEMBER_VALUES}), fam(member, s1, s12) AS (VALUES {', '.join(f"('{m}', {_d(a)}, {_d(b)})" for m, (a, b) in FAMILIES.items())}), l(level, t1, t12) AS (VALUES {LEVEL_VALUES}),
scaled AS (SELECT cell, f, member, w, CASE WHEN cell % 9 <> 4 THEN a1 * s1 END AS a1, a12 * s12 AS a12, (cell % 5) / {_d(5.0)} AS seen FROM amounts JOIN m USING (member) JOIN fam USING (member))"""


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts by family factors; every ninth cell knows no hourly ones; the share of a12 that is measured goes by cell."""
    pick = lambda k: F.element_at(F.create_map(*[x for m, v in FAMILIES.items() for x in (F.lit(m), F.lit(v[k]))]), F.col("member"))
    a = amounts(spark, sf)
    return a.select("cell", "f", "member", "w", F.when(F.col("cell") % 9 != 4, F.col("a1") * pick(0)).alias("a1"), (F.col("a12") * pick(1)).alias("a12"), (F.col("cell") % 5 / 5.0).alias("seen"))


@query(f"""WITH {SCALED}, x AS (SELECT cell, f, level, w, a1, CASE WHEN a1 IS NOT NULL THEN {_dressed('a1 / t1', _d(0.8), _d(1.2))} ELSE 0 END AS p1, {_dressed('a12 / t12', 'greatest(CAST(0.6 AS DOUBLE) * (1 - seen), CAST(0.15 AS DOUBLE))', '(seen * CAST(0.9 AS DOUBLE) + (1 - seen) * CAST(1.1 AS DOUBLE))')} AS p12 FROM scaled, l),
raw AS (SELECT cell, f, level, sum(w * greatest(p1, p12)) / sum(w) AS raw, coalesce(sum(CASE WHEN a1 IS NOT NULL THEN w * p1 END) / sum(CASE WHEN a1 IS NOT NULL THEN w END), 0) AS p1, sum(w * p12) / sum(w) AS p12 FROM x GROUP BY 1, 2, 3)
SELECT cell, f, level, round(min(raw) OVER (PARTITION BY cell, f ORDER BY level), 6) AS p, round(p1, 6) AS p1, round(p12, 6) AS p12 FROM raw""")
def dressed_measured_share(spark: SparkSession, sf: str) -> DataFrame:
    return P.dressed_amounts(scaled(spark, sf), ["cell", "f"], levels_of(THRESHOLDS), 0.6, 1.1, 0.8, 1.2, 0.15, 0.9).select("cell", "f", "level", *r6("p", "p1", "p12"))


@query(f"""WITH {SCALED}, q AS (SELECT cell, f, x, sum(w) OVER (PARTITION BY cell, f ORDER BY x) / sum(w) OVER (PARTITION BY cell, f) AS c FROM (SELECT cell, f, a12 AS x, sum(w) AS w FROM scaled GROUP BY 1, 2, 3))
SELECT cell, f, round(min(CASE WHEN c >= {_d(0.5)} - 1e-9 THEN x END), 4) AS e50, round(min(CASE WHEN c >= {_d(0.9)} - 1e-9 THEN x END), 4) AS e90 FROM q GROUP BY 1, 2""")
def scaled_amount_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.weighted import step_quantiles

    out = step_quantiles(scaled(spark, sf), ["cell", "f"], "a12", "w", {"e50": 0.5, "e90": 0.9})
    return out.select("cell", "f", F.round("e50", 4).alias("e50"), F.round("e90", 4).alias("e90"))


ZONE = f"""zr AS (SELECT cell % 8 AS zone, f, member, level, any_value(w) AS w, max(greatest(coalesce(a12 / t12, -1), coalesce(a1 / t1, -1))) AS ratio FROM scaled, l GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {SCALED}, {ZONE} SELECT zone, f, member, level, round(ratio, 6) AS ratio, round(w / sum(w) OVER (PARTITION BY zone, f, level), 6) AS share FROM zr WHERE ratio >= 0")
def zone_member_ratios(spark: SparkSession, sf: str) -> DataFrame:
    a = scaled(spark, sf).withColumn("zone", F.col("cell") % 8)
    return P.zone_ratios(a, ["zone", "f"], "member", "w", levels_of(THRESHOLDS)).select("zone", "f", "member", "level", *r6("ratio", "share"))


@query(f"""WITH {SCALED}, {ZONE}, truth AS (SELECT cell % 8 AS zone, f, level, bool_or(a1 >= t1 OR a12 >= t12) AS event FROM amounts, l WHERE member = 'view' GROUP BY 1, 2, 3),
r AS (SELECT zone, f, level, sum(CASE WHEN ratio >= 1 THEN w ELSE 0 END) / sum(w) AS p FROM zr WHERE ratio >= 0 AND member <> 'view' GROUP BY 1, 2, 3) SELECT zone, f, level, round(p, 6) AS p, event FROM r JOIN truth USING (zone, f, level)""")
def zone_day_units(spark: SparkSession, sf: str) -> DataFrame:
    """Units to verify: what share of the scenarios reached a level somewhere in a zone, and whether the observed (views) did."""
    a = scaled(spark, sf).withColumn("zone", F.col("cell") % 8)
    r = P.zone_ratios(a.where("member <> 'view'"), ["zone", "f"], "member", "w", levels_of(THRESHOLDS))
    p = r.groupBy("zone", "f", "level").agg(F.sum(F.when(F.col("ratio") >= 1, F.col("share")).otherwise(0.0)).alias("p"))
    seen = amounts(spark, sf).where("member = 'view'").select((F.col("cell") % 8).alias("zone"), "f", F.col("a1").alias("o1"), F.col("a12").alias("o12"))
    return p.join(P.zone_truth(seen, ["zone", "f"], levels_of(THRESHOLDS)), ["zone", "f", "level"]).select("zone", "f", "level", *r6("p"), "event")


@query("""WITH pl AS (SELECT c_custkey AS id, c_custkey % 31 + 1 AS unit, CAST(38 AS DOUBLE) + c_custkey * 37 % 3001 / CAST(1000 AS DOUBLE) AS lat, CAST(-1 AS DOUBLE) + c_custkey * 53 % 2503 / CAST(1000 AS DOUBLE) AS lon FROM customer),
pt AS (SELECT s_suppkey AS pt, s_suppkey % 97 + 20 AS unit, CAST(38 AS DOUBLE) + s_suppkey * 131 % 3001 / CAST(1000 AS DOUBLE) AS lat, CAST(-1 AS DOUBLE) + s_suppkey * 293 % 2503 / CAST(1000 AS DOUBLE) AS lon FROM supplier),
ch AS (SELECT u AS unit, CASE k WHEN 0 THEN u WHEN 1 THEN u // 2 WHEN 2 THEN u // 4 WHEN 3 THEN u // 8 ELSE u // 16 END AS below, k AS steps FROM range(1, 64) a(u), range(5) b(k)), chains AS (SELECT unit, below, min(steps) AS steps FROM ch WHERE below > 0 GROUP BY 1, 2),
c AS (SELECT id, (array_agg(pt ORDER BY steps, pt))[1] AS chained FROM pl JOIN chains USING (unit) JOIN pt ON pt.unit = below GROUP BY 1),
n AS (SELECT id, (array_agg(pt ORDER BY km, pt))[1] AS near FROM (SELECT pl.id, pt, 6371 * sqrt(pow(radians(pt.lon - pl.lon) * cos(radians((pl.lat + pt.lat) / 2)), 2) + pow(radians(pt.lat - pl.lat), 2)) AS km FROM pl, pt) WHERE km <= 12 GROUP BY 1)
SELECT pl.id, coalesce(chained, near) AS pt, CASE WHEN chained IS NOT NULL THEN 'chain' WHEN near IS NOT NULL THEN 'near' END AS by FROM pl LEFT JOIN c ON c.id = pl.id LEFT JOIN n ON n.id = pl.id""")
def control_point_below(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.plans.space_queries import places

    p, o = places(spark, sf)
    units = F.broadcast(spark.createDataFrame([(u, u >> k, k) for u in range(1, 64) for k in range(5) if u >> k], "unit long, below long, steps int"))
    return P.first_below(p.withColumn("unit", F.col("id") % 31 + 1), units, o.select(F.col("oid").alias("pt"), (F.col("oid") % 97 + 20).alias("unit"), F.col("olat").alias("lat"), F.col("olon").alias("lon")))


RANKS = ("view", "click", "error", "purchase", "signup")


@query(f"""WITH {hourly_sql('event_type')}, e AS (SELECT min(t) AS lo, max(t) AS hi FROM hourly), ax AS (SELECT lo - lo % 3 + k * 3 AS t FROM e, range(0, 21) a(k) UNION ALL SELECT t FROM (SELECT unnest(range(lo - lo % 3 + 61, hi + 1)) AS t FROM e) WHERE t % 6 = 0),
r AS (SELECT CAST(list_position({list(RANKS)}, s) - 1 AS INT) AS rank, s AS run, t FROM hourly WHERE t % 6 <> list_position({list(RANKS)}, s) % 6) SELECT t, arg_min(run, rank) AS run, min(rank) AS rank FROM ax JOIN r USING (t) GROUP BY t""")
def run_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The best run of each time of an axis over all hours: by three hours at first, then by six. Each run lacks hours of its own."""
    place = F.array_position(F.array(*[F.lit(x) for x in RANKS]), F.col("s"))
    h = hourly(spark, sf, "event_type").select("s", "t")
    runs = h.where(F.col("t") % 6 != place % 6).select((place - 1).cast("int").alias("rank"), F.col("s").alias("run"), "t")
    ends = h.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return P.run_of_each_time(P.mixed_axis(ends, 60), runs)


FC = "f AS (SELECT l_suppkey % 10 AS grp, (l_quantity * 7 + l_linenumber * 11) % 50 / CAST(50 AS DOUBLE) AS p, l_returnflag = 'R' AS event, CAST(1 + l_partkey % 3 AS DOUBLE) AS w, l_linenumber % 3 AS stratum FROM lineitem)"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_suppkey") % 10).alias("grp"), ((F.col("l_quantity") * 7 + F.col("l_linenumber") * 11) % 50 / 50.0).alias("p"), (F.col("l_returnflag") == "R").alias("event"), (1 + F.col("l_partkey") % 3).cast("double").alias("w"), (F.col("l_linenumber") % 3).alias("stratum"))


@query(f"""WITH {FC}, t(tau) AS (SELECT CAST(k / 10.0 AS DOUBLE) + CAST(0.01 AS DOUBLE) FROM range(0, 10) x(k)), o AS (SELECT grp, tau, sum(CASE WHEN p >= tau AND event THEN w ELSE 0 END) AS h, sum(CASE WHEN p < tau AND event THEN w ELSE 0 END) AS m, sum(CASE WHEN p >= tau AND NOT event THEN w ELSE 0 END) AS a FROM f, t GROUP BY 1, 2),
r AS (SELECT *, sum(h) OVER v - h AS rh, sum(m) OVER v - m AS rm, sum(a) OVER v - a AS ra FROM o WINDOW v AS (PARTITION BY tau)), c AS (SELECT *, coalesce(rh / nullif(rh + rm + ra, 0), 0) AS csi FROM r), k AS (SELECT *, max(csi) OVER (PARTITION BY grp) AS top FROM c)
SELECT grp, round(max(tau), 4) AS tau, arg_max(h, tau) AS hits, arg_max(m, tau) AS misses, arg_max(a, tau) AS alarms FROM k WHERE csi >= top - CAST(0.005 AS DOUBLE) GROUP BY grp""")
def nested_tau(spark: SparkSession, sf: str) -> DataFrame:
    return P.nested_threshold(scored(spark, sf), "grp", "p", "event", "w", [k / 10 + 0.01 for k in range(10)]).withColumn("tau", F.round("tau", 4))


SUMS = f"""{FC}, it AS (SELECT k AS candidate, grp, stratum, level, count(*) AS n, count(*) FILTER (WHERE event AND level = 2 OR event AND w > 1) AS events, sum(pow(least(p * k / 4, 1) - CASE WHEN event AND (level = 2 OR w > 1) THEN 1 ELSE 0 END, 2)) AS sq FROM f, range(1, 9) x(k), (VALUES (2), (3)) l(level) GROUP BY 1, 2, 3, 4)"""


def item_sums(spark: SparkSession, sf: str) -> DataFrame:
    """candidate, grp, stratum, level: n, events and the sum of squared errors, dry pairs (p = 0) included."""
    rows = scored(spark, sf).withColumn("level", F.explode(F.array(F.lit(2), F.lit(3)))).withColumn("candidate", F.explode(F.sequence(F.lit(1), F.lit(8))))
    e = F.col("event") & ((F.col("level") == 2) | (F.col("w") > 1))
    return rows.groupBy("candidate", "grp", "stratum", "level").agg(F.count("*").alias("n"), F.count_if(e).alias("events"), F.sum(F.pow(F.least(F.col("p") * F.col("candidate") / 4, F.lit(1.0)) - e.cast("int"), F.lit(2.0))).alias("sq"))


@query(f"WITH {SUMS} SELECT candidate, grp, stratum, CAST(level AS INT) AS level, n, events, round(sq, 6) AS sq FROM it")
def item_error_sums(spark: SparkSession, sf: str) -> DataFrame:
    return item_sums(spark, sf).select("candidate", "grp", F.col("stratum").cast("long").alias("stratum"), "level", "n", "events", F.round("sq", 6).alias("sq"))


@query(f"""WITH {SUMS}, o AS (SELECT candidate, grp, level, sum((1 + stratum) * n) AS n, sum((1 + stratum) * events) AS e, sum((1 + stratum) * sq) AS s, sum(events) AS raw FROM it GROUP BY 1, 2, 3),
r AS (SELECT *, sum(n) OVER v - n AS rn, sum(e) OVER v - e AS re, sum(s) OVER v - s AS rs, sum(raw) OVER v >= 30 AND count(*) FILTER (WHERE raw > 0) OVER v >= 2 AS fit FROM o WINDOW v AS (PARTITION BY candidate, level)),
k AS (SELECT grp, candidate, coalesce(avg(CASE WHEN fit AND re / rn * (1 - re / rn) > 0 THEN 1 - rs / rn / (re / rn * (1 - re / rn)) END), -9) AS bss FROM r GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(bss, 9) DESC, candidate) AS rank FROM k)
SELECT grp, CAST(candidate AS INT) AS candidate, round(bss, 6) AS bss FROM b WHERE rank = 1""")
def loco_best_skill(spark: SparkSession, sf: str) -> DataFrame:
    rows = item_sums(spark, sf).withColumn("weight", (1 + F.col("stratum")).cast("double"))
    return P.leave_one_out_skill(rows, "candidate", "grp", "stratum", [2, 3]).select("grp", "candidate", *r6("bss"))


WIND = f"wind AS (SELECT plane, CAST(30 AS DOUBLE) + j AS lat, CAST(-10 AS DOUBLE) + i * 2 AS lon, v - 20 AS u, (v * 7) % 31 - 10 AS w FROM field)"


@query(f"""WITH {FIELD}, {WIND}, k AS (SELECT *, sqrt(u * u + w * w) AS speed, 6371 * acos(least(greatest(sin(radians(39.47)) * sin(radians(lat)) + cos(radians(39.47)) * cos(radians(lat)) * cos(radians(lon + 0.38)), -1), 1)) AS km FROM wind), r AS (SELECT *, row_number() OVER (PARTITION BY plane ORDER BY speed DESC, lat, lon) AS n FROM k WHERE km <= 2500),
b AS (SELECT *, atan2(sin(radians(-0.38 - lon)) * cos(radians(39.47)), cos(radians(lat)) * sin(radians(39.47)) - sin(radians(lat)) * cos(radians(39.47)) * cos(radians(-0.38 - lon))) AS back FROM r WHERE n = 1),
q AS (SELECT *, (km * sin(back) * u + km * cos(back) * w) / speed AS along, (u * km * cos(back) - w * km * sin(back)) / speed AS left_of FROM b), n AS (SELECT *, CASE WHEN speed >= 30 THEN CASE WHEN left_of > 0 THEN 'left' ELSE 'right' END || CASE WHEN along > 0 THEN '-exit' ELSE '-entrance' END END AS quadrant FROM q)
SELECT plane, round(speed, 6) AS speed, lat, lon, round(km, 3) AS km, quadrant, coalesce(quadrant IN ('left-exit', 'right-entrance') AND km <= 1200, false) AS favourable FROM n""")
def jet_streak(spark: SparkSession, sf: str) -> DataFrame:
    wind = field(spark, sf).select("plane", (30.0 + F.col("j")).alias("lat"), (-10.0 + F.col("i") * 2).alias("lon"), (F.col("v") - 20).alias("u"), (F.col("v") * 7 % 31 - 10).alias("v"))
    return P.jet_streak(wind, ["plane"], 39.47, -0.38).select("plane", *r6("speed"), "lat", "lon", F.round("km", 3).alias("km"), "quadrant", "favourable")


@query(f"""WITH {hourly_sql()} SELECT s, t // 24 AS day, t % 24 AS hour, CAST(u AS DOUBLE) AS rung, round(greatest(c / CAST(100 AS DOUBLE) - u, 0) / least(n / CAST(2 AS DOUBLE), 1), 6) AS excess FROM hourly, (VALUES (0), (10), (50)) r(u) WHERE least(n / CAST(2 AS DOUBLE), 1) >= CAST(0.6 AS DOUBLE)""")
def day_ladders(spark: SparkSession, sf: str) -> DataFrame:
    h = hourly(spark, sf).withColumn("rung", F.explode(F.array(F.lit(0.0), F.lit(10.0), F.lit(50.0))))
    parts = h.select("s", F.floor(F.col("t") / 24).alias("day"), (F.col("t") % 24).alias("hour"), "rung", F.greatest(F.col("c") / 100.0 - F.col("rung"), F.lit(0.0)).alias("excess"), F.least(F.col("n") / 2.0, F.lit(1.0)).alias("coverage"))
    return P.day_ladders(parts, ["s", "day"]).select("s", "day", "hour", "rung", *r6("excess"))


@query("""WITH p AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS x FROM part), c AS (SELECT *, [8 + k % 3, 14 + k % 5, 22 + k % 5, 30 + k % 7] AS lo, [12 + k % 3, 20 + k % 5, 30 + k % 5, 44 + k % 7] AS hi, [2, 5, 10, 50] AS y FROM p)
SELECT k, round(CASE WHEN x <= hi[1] THEN 2 WHEN x < hi[2] THEN exp(ln(2) + (x - hi[1]) / (hi[2] - hi[1]) * ln(2.5)) WHEN x < hi[3] THEN exp(ln(5) + (x - hi[2]) / (hi[3] - hi[2]) * ln(2)) WHEN x < hi[4] THEN exp(ln(10) + (x - hi[3]) / (hi[4] - hi[3]) * ln(5)) ELSE 1e9 END, 5) AS least_years,
round(CASE WHEN x <= lo[1] THEN 2 WHEN x < lo[2] THEN exp(ln(2) + (x - lo[1]) / (lo[2] - lo[1]) * ln(2.5)) WHEN x < lo[3] THEN exp(ln(5) + (x - lo[2]) / (lo[3] - lo[2]) * ln(2)) WHEN x < lo[4] THEN exp(ln(10) + (x - lo[3]) / (lo[4] - lo[3]) * ln(5)) ELSE 1e9 END, 5) AS most_years FROM c""")
def return_period_band(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    lo, hi = [8 + k % 3, 14 + k % 5, 22 + k % 5, 30 + k % 7], [12 + k % 3, 20 + k % 5, 30 + k % 5, 44 + k % 7]
    a, b = P.return_period_range(F.col("p_size").cast("double"), [2, 5, 10, 50], lo, hi)
    return table(spark, sf, "part").select(k.alias("k"), F.round(F.least(a, F.lit(1e9)), 5).alias("least_years"), F.round(F.least(b, F.lit(1e9)), 5).alias("most_years"))


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'regulated' WHEN p_partkey % 5 = 0 THEN 'few gauges' WHEN p_size / CAST(60 AS DOUBLE) >= 0.5 THEN 'near miss' WHEN p_retailprice / 1000 < 1.5 THEN 'marginal' ELSE 'complete miss' END || CASE WHEN p_size % 2 = 0 THEN ', recovered' ELSE '' END AS cause FROM part""")
def causes_of_misses(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(k.alias("k"), P.flood_cause(size / 60.0, k % 7 == 0, k % 5 == 0, F.col("p_retailprice") / 1000, size % 2 == 0).alias("cause"))


@query("""WITH c AS (SELECT p_partkey AS id, p_size * CAST(10 AS DOUBLE) AS area, CASE WHEN p_partkey % 4 > 0 THEN p_size * CAST(2 AS DOUBLE) END AS t2, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END AS section, CASE WHEN p_partkey % 5 = 0 THEN 'low' WHEN p_partkey % 5 < 4 THEN 'high' END AS confidence, p_partkey % 6 = 0 AS confined, [p_size * CAST(3 AS DOUBLE), p_retailprice / 7, p_size / CAST(2 AS DOUBLE)] AS published, CASE WHEN p_partkey % 11 = 0 THEN CAST(125 AS DOUBLE) END AS observed FROM part),
b AS (SELECT *, 100 * pow(greatest(area, 1), CAST(-0.4 AS DOUBLE)) * area AS top, coalesce(t2 / 2, 0) AS low FROM c), s AS (SELECT *, CASE WHEN section BETWEEN low AND top AND confidence IS DISTINCT FROM 'low' AND NOT confined THEN round(section, 1) END AS sec, list_min(list_filter(published, lambda x: x >= low AND x <= top)) AS pub FROM b)
SELECT id, round(coalesce(observed, sec, pub), 4) AS q, CASE WHEN observed IS NOT NULL THEN 'observed' WHEN sec IS NOT NULL THEN 'section' WHEN pub IS NOT NULL THEN 'published' END AS kind FROM s""")
def channel_capacity(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf, "part").select(
        k.alias("id"), (size * 10.0).alias("area"), F.when(k % 4 > 0, size * 2.0).alias("t2"), F.when(k % 3 > 0, F.col("p_retailprice")).alias("section"), F.when(k % 5 == 0, "low").when(k % 5 < 4, "high").alias("confidence"),
        (k % 6 == 0).alias("confined"), F.array(size * 3.0, F.col("p_retailprice") / 7, size / 2.0).alias("published"), F.when(k % 11 == 0, 125.0).alias("observed"),
    )
    return P.channel_capacity(rows).select("id", F.round("q", 4).alias("q"), "kind")


@query("""WITH st AS (SELECT o_custkey AS code, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS inst, o_orderdate AS inst_day, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice / 2 END AS daily, o_orderdate - INTERVAL 1 DAY AS daily_day FROM orders),
p AS (SELECT code, coalesce(inst, daily) AS peak, CAST(CASE WHEN inst IS NOT NULL THEN inst_day ELSE daily_day END AS DATE) AS day, inst IS NOT NULL AS measured FROM st WHERE coalesce(inst, daily) IS NOT NULL), pl AS (SELECT c_custkey AS code, c_nationkey AS point FROM customer WHERE c_acctbal > 0),
d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INT) AS yr FROM orders), known AS (SELECT DISTINCT CAST(1992 + n_nationkey % 7 AS INT) AS yr, n_nationkey AS point FROM nation)
SELECT d.yr AS "case", point, round(peak, 4) AS peak, measured, CAST(day AS VARCHAR) AS day FROM p JOIN pl USING (code) JOIN d USING (day) ANTI JOIN known ON known.yr = d.yr AND known.point = pl.point""")
def station_facts(spark: SparkSession, sf: str) -> DataFrame:
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    st = o.select(F.col("o_custkey").alias("code"), F.when(k % 3 > 0, F.col("o_totalprice")).alias("inst"), day.alias("inst_day"), F.when(k % 5 > 0, F.col("o_totalprice") / 2).alias("daily"), F.date_sub(day, 1).alias("daily_day"))
    pl = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("code"), F.col("c_nationkey").alias("point"))
    days = o.select(day.alias("day"), F.year(day).alias("case")).distinct()
    known = table(spark, sf, "nation").select((1992 + F.col("n_nationkey") % 7).cast("int").alias("case"), F.col("n_nationkey").alias("point"))
    return P.station_facts(st, pl, days, known).select("case", "point", F.round("peak", 4).alias("peak"), "measured", F.col("day").cast("string").alias("day"))


@query("""SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size <= 2 THEN 'h1-2' WHEN p_size <= 4 THEN 'h3-4' ELSE 'h5-6' END WHEN 1 THEN CASE WHEN p_size <= 30 THEN 'd1' ELSE 'd2' END ELSE CASE WHEN p_size * 4 <= 96 THEN 'd2-3' WHEN p_size * 4 <= 144 THEN 'd4-5' ELSE 'd6-7' END END AS lead,
round_even(p_retailprice / 7, 1) AS r1, CASE WHEN p_size % 2 = 0 THEN CAST(round_even(p_retailprice, 0) AS BIGINT) END AS whole, round((p_size - 25) / CAST(7 + p_partkey % 4 AS DOUBLE), 6) AS z FROM part""")
def lead_classes_and_rounding(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    horizon = F.when(k % 3 == 0, "now").when(k % 3 == 1, "mid").otherwise("long")
    lead = S.lead_class(horizon, F.when(k % 3 == 2, size * 4).otherwise(size))
    z = S.standardised(size.cast("double"), F.lit(25.0), (7 + k % 4).cast("double"))
    return table(spark, sf, "part").select(k.alias("k"), lead.alias("lead"), F.bround(F.col("p_retailprice") / 7, 1).alias("r1"), F.when(size % 2 == 0, F.bround("p_retailprice", 0).cast("long")).alias("whole"), F.round(z, 6).alias("z"))


@query("""WITH w AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS onset, o_custkey AS zone, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 ELSE 2 END AS level FROM orders) SELECT k, CAST(row_number() OVER (PARTITION BY year(onset) ORDER BY onset, zone, level DESC, k) AS INT) AS place FROM w""")
def warnings_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """By onset, then zone, the highest level first; a list for each year."""
    from pyspark.sql import Window

    level = F.when(F.col("o_orderpriority") == "1-URGENT", 4).when(F.col("o_orderpriority") == "2-HIGH", 3).otherwise(2)
    w = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("onset"), F.col("o_custkey").alias("zone"), level.alias("level"))
    return w.select("k", F.row_number().over(Window.partitionBy(F.year("onset")).orderBy("onset", "zone", F.desc("level"), "k")).alias("place"))


@query(f"WITH {hourly_sql('event_type')} SELECT a.t, a.c AS level, b.c AS volume FROM hourly a JOIN hourly b ON a.t = b.t WHERE a.s = 'view' AND b.s = 'click'")
def paired_series(spark: SparkSession, sf: str) -> DataFrame:
    h = hourly(spark, sf, "event_type")
    return h.where("s = 'view'").select("t", F.col("c").alias("level")).join(h.where("s = 'click'").select("t", F.col("c").alias("volume")), "t")


def _falls(n: int) -> str:
    return ", ".join(f"least({', '.join(f'c{j}' for j in range(k + 1))}) AS p{k + 2}" if k else "c0 AS p2" for k in range(n))


def _level(n: int) -> str:
    return f"CAST(greatest(1, {', '.join(f'CASE WHEN p{k + 2} >= {_d(TAU[k])} THEN {k + 2} ELSE 1 END' for k in range(n))}) AS INT) AS level"


def _three(x: str, qs: dict[str, float]) -> str:
    return ", ".join(f"min(CASE WHEN c >= {_d(q)} - 1e-9 THEN {x} END) AS {n}" for n, q in qs.items())


MW = f"mw(m, w) AS (VALUES {', '.join(f"('{m}', {_d(x)})" for m, x in WEIGHTS)})"
SERIES = f"raw AS (SELECT event_type AS m, user_id % 9 AS k, CAST(ceil(epoch_us(ts) / 3600000000.0) AS BIGINT) AS t, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS c FROM events GROUP BY 1, 2, 3)"
FR = f"fr AS (SELECT f, {START} + 24 * f AS t0, {START} + 24 * f + 24 AS t1 FROM range({DAYS}) x(f))"


def series(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("member"), (F.col("user_id") % 9).alias("k"), W.step_end(F.col("ts")).alias("t")).agg(F.sum(cents("value")).alias("c"))
    return e.withColumn("w", F.element_at(F.create_map(*[x for m, v in WEIGHTS for x in (F.lit(m), F.lit(v))]), F.col("member")))


def days(spark: SparkSession) -> DataFrame:
    return spark.range(DAYS).select(F.col("id").alias("f"), (START + 24 * F.col("id")).alias("t0"), (START + 24 * F.col("id") + 24).alias("t1"))


LIMITS = [20.0, 45.0, 90.0, 180.0]


@query(f"""WITH {SERIES}, {MW}, {FR}, q AS (SELECT m, k, t, {_d(0.2)} * exp(-(t - {START}) / {_d(5.0)}) * sum(c / {_d(70.0)} * exp((t - {START}) / {_d(5.0)})) OVER (PARTITION BY m, k ORDER BY t) AS q FROM raw),
pk AS (SELECT m, k AS pt, f, max(q) AS peak FROM q JOIN fr ON t > t0 AND t <= t1 GROUP BY 1, 2, 3), k AS (SELECT * FROM pk JOIN mw USING (m)),
p AS (SELECT f, pt, {', '.join(f"sum(w * {'greatest(' if j < 2 else ''}{_dressed(f'peak / {_d(x)}', _d(SIGMA))}{', CASE WHEN pt % 4 = 0 THEN CAST(0.2 AS DOUBLE) ELSE 0 END)' if j < 2 else ''}) / sum(w) AS c{j}" for j, x in enumerate(LIMITS))} FROM k GROUP BY 1, 2),
n AS (SELECT f, pt, {_falls(4)} FROM p), s AS (SELECT f, pt, peak, sum(w) OVER (PARTITION BY f, pt ORDER BY peak) / sum(w) OVER (PARTITION BY f, pt) AS c FROM (SELECT f, pt, peak, sum(w) AS w FROM k GROUP BY 1, 2, 3)), z AS (SELECT f, pt, {_three('peak', {'peak_50': 0.5, 'peak_90': 0.9})} FROM s GROUP BY 1, 2)
SELECT f, pt, round(p2, 5) AS p2, round(p3, 5) AS p3, round(p4, 5) AS p4, round(p5, 5) AS p5, {_level(4)}, round(peak_50, 5) AS peak_50, round(peak_90, 5) AS peak_90 FROM n JOIN z USING (f, pt)""")
def discharge_product(spark: SparkSession, sf: str) -> DataFrame:
    """Routed rain of each member at nine points, some of which have a vote."""
    x = series(spark, sf).withColumn("x", F.col("c") / 70.0)
    q = W.fading_sum(x, ["member", "k"], "x", 5.0, "q", 0.2).select("member", F.col("k").alias("pt"), "t", "q", "w", F.when(F.col("k") % 4 == 0, 0.2).otherwise(0.0).alias("vote"))
    points = spark.range(9).select(F.col("id").alias("pt"), F.array(*[F.lit(v) for v in LIMITS]).alias("limits"))
    out = P.discharge_product(q, points, days(spark), "w", TAU, SIGMA, "vote")
    return out.select("f", "pt", *[F.round(f"p{k}", 5).alias(f"p{k}") for k in range(2, 6)], "level", F.round("peak_50", 5).alias("peak_50"), F.round("peak_90", 5).alias("peak_90"))


@query(f"""WITH {SERIES}, {MW}, {FR}, sim AS (SELECT m, k AS dam, t, 5 + c / {_d(9000.0)} AS volume, c / {_d(300.0)} AS outflow, CASE WHEN c > 60000 THEN c / {_d(1700.0)} ELSE 0 END AS spill FROM raw),
d AS (SELECT k AS dam, {_d(7.0)} AS start, 10 + k AS fll, CASE WHEN k % 4 < 3 THEN 14 + k END AS top, CASE WHEN k % 3 = 0 THEN 9 + k / {_d(2.0)} END AS res, CASE WHEN k % 5 > 0 THEN {_d(40.0)} END AS able FROM range(9) x(k)),
a AS (SELECT m, dam, f, max(volume) AS most, arg_max(volume, t) AS last, max(outflow) AS q, max(spill) AS over FROM sim JOIN fr ON t > t0 AND t <= t1 GROUP BY 1, 2, 3),
e AS (SELECT *, coalesce(most >= res, false) AS ins, over > 0 OR most >= fll * {_d(0.9995)} AS sp, coalesce(over >= able, false) OR coalesce(most >= top, false) AS de FROM a JOIN d USING (dam) JOIN mw USING (m)),
g AS (SELECT *, sp OR q >= 150 OR q >= 250 OR de AS l3, q >= 250 OR de AS l4, most - start >= 2 OR (ins AND most - start >= {_d(0.5)}) OR q >= 60 AS l2 FROM e),
p AS (SELECT f, dam, sum(CASE WHEN l2 OR l3 THEN w ELSE 0 END) / sum(w) AS c0, sum(CASE WHEN l3 THEN w ELSE 0 END) / sum(w) AS c1, sum(CASE WHEN l4 THEN w ELSE 0 END) / sum(w) AS c2, sum(CASE WHEN de THEN w ELSE 0 END) / sum(w) AS c3, sum(CASE WHEN ins THEN w ELSE 0 END) / sum(w) AS reserve, sum(CASE WHEN sp THEN w ELSE 0 END) / sum(w) AS spilling FROM g GROUP BY 1, 2),
n AS (SELECT f, dam, reserve, spilling, c3 AS design, {_falls(4)} FROM p), s AS (SELECT f, dam, last, sum(w) OVER (PARTITION BY f, dam ORDER BY last) / sum(w) OVER (PARTITION BY f, dam) AS c FROM (SELECT f, dam, last, sum(w) AS w FROM g GROUP BY 1, 2, 3)), z AS (SELECT f, dam, {_three('last', {'v10': 0.1, 'v50': 0.5, 'v90': 0.9})} FROM s GROUP BY 1, 2)
SELECT f, dam, {', '.join(f'round({x}, 6) AS {x}' for x in ('p2', 'p3', 'p4', 'p5', 'reserve', 'spilling', 'design', 'v10', 'v50', 'v90'))}, {_level(4)} FROM n JOIN z USING (f, dam)""")
def reservoir_product(spark: SparkSession, sf: str) -> DataFrame:
    """Volumes and flows of nine dams that stand for what a cascade gives."""
    c, k = F.col("c"), F.col("id")
    sim = series(spark, sf).select("member", F.col("k").alias("dam"), "t", (5 + c / 9000.0).alias("volume"), (c / 300.0).alias("outflow"), F.when(c > 60000, c / 1700.0).otherwise(0.0).alias("spill"), "w")
    dams = spark.range(9).select(
        k.alias("dam"), F.lit(7.0).alias("start"), (10 + k).alias("full"), F.when(k % 4 < 3, 14 + k).alias("top"), F.when(k % 3 == 0, 9 + k / 2.0).alias("reserve_from"), F.when(k % 5 > 0, 40.0).alias("able"), F.lit(2.0).alias("gain"), F.lit(0.5).alias("rise"), F.array(F.lit(60.0), F.lit(150.0), F.lit(250.0)).alias("limits"),
    )
    out = P.reservoir_product(sim, dams, days(spark), "w", TAU)
    return out.select("f", "dam", *r6("p2", "p3", "p4", "p5", "reserve", "spilling", "design", "v10", "v50", "v90"), "level")


@query(f"""WITH {SERIES}, r AS (SELECT m, k, t, hours, sum(b.c) AS amount FROM (SELECT DISTINCT m, k, t FROM raw) a JOIN (VALUES (1), (3), (12), (24)) d(hours) ON true JOIN raw b USING (m, k) WHERE b.t <= a.t AND b.t > a.t - hours AND a.t > {START} + 100 AND a.t <= {START} + 400 GROUP BY 1, 2, a.t, 4)
SELECT m AS member, k, CAST(hours AS INT) AS hours, CAST(max(amount) AS BIGINT) AS amount, (array_agg(t ORDER BY amount DESC, t))[1] AS at FROM r GROUP BY 1, 2, 3""".replace("SELECT m, k, t, hours, sum(b.c)", "SELECT m, k, a.t AS t, hours, sum(b.c)"))
def event_maxima(spark: SparkSession, sf: str) -> DataFrame:
    return P.event_maxima(series(spark, sf).withColumnRenamed("c", "p"), ["member", "k"], START + 100, START + 400, [1, 3, 12, 24])


def _gev_sql(x: str, loc: float, scale: float, xi: float) -> str:
    return f"exp(-pow(greatest(1 + {_d(xi)} * ({x} - {_d(loc)}) / {_d(scale)}, 0), {_d(-1 / xi)}))"


@query(f"""WITH p AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS x, p_retailprice AS a, least(greatest((p_size - 5) / {_d(30.0)}, 0), 1) AS ramp FROM part), c AS (SELECT *, least(greatest({_gev_sql('x', 20.0, 8.0, 0.1)}, {_d(0.02)}), 1 - 1 / {_d(2000.0)}) AS f FROM p)
SELECT k, round(2 * {_d(1.5)} * pow({_d(0.5)}, x / {_d(6.0)}), 6) AS weight, round(ramp, 6) AS ramp, round(exp((ln(greatest(ramp, {_d(0.05)})) + ln(least(greatest(x / 50, {_d(0.05)}), 1))) / 2), 6) AS score, round({_d(0.3)} * pow(x / pow(a / 10000, {_d(0.25)}), {_d(0.76)}), 6) AS hours,
round(least(greatest({_d(1.1)} * sqrt(a / 10000) * pow(x, {_d(0.2)}), {_d(0.5)}), 3), 6) AS speed, round(least(greatest({_d(0.35)} * pow(a, {_d(0.45)}), 1), 12), 6) AS response, round({_d(30.0)} + {_d(12.0)} * (exp({_d(0.2)} * -ln(-ln(f))) - 1) / {_d(0.2)}, 4) AS mapped FROM c""")
def weights_and_terrain(spark: SparkSession, sf: str) -> DataFrame:
    x, a = F.col("p_size").cast("double"), F.col("p_retailprice")
    ramp = S.ramp(x, 5.0, 35.0)
    out = {
        "weight": S.aged_weight(F.lit(2.0), F.lit(1.5), x, 6.0), "ramp": ramp, "score": S.ingredients_score([ramp, x / 50]), "hours": S.travel_time(x, a / 10000), "speed": S.stream_velocity(a / 10000, x, 1.1, 0.5, 3.0), "response": S.response_time(a, 0.35, 0.45, 12.0),
    }
    mapped = S.quantile_map(x, (20.0, 8.0, 0.1), (30.0, 12.0, 0.2))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), *[F.round(c, 6).alias(n) for n, c in out.items()], F.round(mapped, 4).alias("mapped"))


@query(f"WITH {hourly_sql()} SELECT s % 50 AS place, round(avg(c), 4) AS mean, round(quantile_cont(c, 0.5), 4) AS p50, round(quantile_cont(c, 0.9), 4) AS p90, CAST(max(c) AS BIGINT) AS top, round(avg(CASE WHEN c >= 2000 THEN 1 ELSE 0 END), 6) AS p_2000, round(avg(CASE WHEN c >= 20000 THEN 1 ELSE 0 END), 6) AS p_20000 FROM hourly GROUP BY 1")
def ensemble_summary(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.sources.catalogue import ensemble_summary as summary

    out = summary(hourly(spark, sf).withColumn("place", F.col("s") % 50), ["place"], "c", [2000, 20000])
    return out.select("place", *[F.round(c, 4).alias(c) for c in ("mean", "p50", "p90")], "top", *r6("p_2000", "p_20000"))
