"""Operators against answers worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.functions import special
from tessera.operators import ensemble as E
from tessera.operators import extremes as X
from tessera.operators import graph as R
from tessera.operators import grids as G
from tessera.operators import hydrology as Y
from tessera.operators import joins as J
from tessera.operators import verify as V
from tessera.operators import weighted as Q
from tessera.operators import windows as W


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_step_quantile_takes_values_that_occur(spark):
    df = spark.createDataFrame([(1, 1.0, 3.0), (1, 2.0, 1.0), (1, 10.0, 1.0), (1, None, 5.0), (2, 4.0, 0.0)], "k int, v double, w double")
    got = rows(Q.step_quantiles(df, ["k"], "v", "w", {"a": 0.5, "b": 0.8, "c": 0.9}), "k")
    assert got == [(1, 3.0, 1.0, 2.0, 10.0), (2, None, None, None, None)]


def test_frames_are_right_closed_and_look_back(spark):
    df = spark.createDataFrame([(1, t, 1.0) for t in range(1, 14)], "s int, t long, p double")
    frame = spark.createDataFrame([("x", 0, 12, 13), ("y", 1, 13, 17)], "horizon string, f int, t0 long, t1 long")
    assert rows(W.frame_amounts(df, ["s"], frame, "p").select("f", "a1", "a12"), "f") == [(0, 1.0, 12.0)]


def test_trailing_sum_reaches_over_gaps(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 12, 0.0), (1, 13, 0.0)], "s int, t long, p double")
    assert [r[3] for r in rows(W.trailing(df, ["s"], "p", 12, "a"), "t")] == [5.0, 5.0, 0.0]


def test_accumulations_spread_over_their_steps(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 3, 6.0), (1, 5, 4.0)], "s int, t long, p double")
    assert [r[3] for r in rows(W.spread_accumulations(df, ["s"], "p", True).select("s", "gap", "t", "p"), "t")] == [0.0, 2.0, 2.0, 2.0, 0.0, 0.0]


def test_events_and_episodes(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (1, 20, 1.0)], "s int, t long, p double")
    assert [(r.t0, r.t1, r.total, r.t_peak) for r in W.events(df, ["s"], F.col("p") > 0, "p", 12).orderBy("t0").collect()] == [(1, 2, 5.0, 2), (20, 20, 1.0, 20)]
    iv = spark.createDataFrame([(1, 0, 30), (1, 25, 40), (1, 60, 90)], "k int, a int, b int")
    assert [r.episode for r in W.merge_intervals(iv, ["k"], "a", "b").orderBy("a").collect()] == [0, 0, 1]


def test_despike_removes_a_plateau_and_the_samples_around_it(spark):
    v = [1.0, 1.1, 1.2, 1.1, 9.0, 9.1, 9.0, 1.1, 1.0, 3.0, 2.9]
    df = spark.createDataFrame([(1, t, x) for t, x in enumerate(v)], "s int, t long, v double")
    assert [r.clean for r in W.despike(df, ["s"], "v").orderBy("t").collect()] == [1.0, 1.1, None, None, None, None, None, None, None, 3.0, 2.9]
    # a fall of less than 2, and one that was not entered by a jump, stay
    for v in ([0.1, 1.5, 1.5, 0.1], [1.0, 6.0, 9.0, 1.0]):
        df = spark.createDataFrame([(1, t, x) for t, x in enumerate(v)], "s int, t long, v double")
        assert [r.clean for r in W.despike(df, ["s"], "v").orderBy("t").collect()] == v


def test_despike_of_stacked_plateaus_equals_a_walk(spark):
    """Against the rule walked by hand over random steps, several series at once."""
    rng = np.random.default_rng(4)
    series = {k: [float(x) for x in np.repeat(rng.choice([0.5, 1.0, 6.0, 6.3, 20.0, 45.0], 60), rng.integers(1, 5, 60))] for k in range(4)}
    series[4] = [0.1] * 3 + [50.0] * 75 + [0.2] * 4 + [50.0] * 72 + [0.2] * 3  # one plateau is too long
    df = spark.createDataFrame([(k, t, x) for k, v in series.items() for t, x in enumerate(v)] + [(9, 0, None)], "s int, t long, v double")
    got = {(r.s, r.t): r.clean for r in W.despike(df, ["s"], "v").collect()}
    for k, v in series.items():
        alive = list(range(len(v)))
        for _ in range(4):
            x, lost = [v[t] for t in alive], set()
            for e in range(len(x) - 1):
                if x[e + 1] < 0.4 * x[e] and x[e] - x[e + 1] > 2:
                    off = [b for b in range(max(e - 73, 0), e) if abs(x[b] - x[e]) > 0.12 * x[e]]
                    if off and x[off[-1]] < 0.5 * x[e]:
                        lost |= set(range(max(off[-1] - 1, 0), min(e + 2, len(x) - 1) + 1))
            if not lost:
                break
            alive = [t for n, t in enumerate(alive) if n not in lost]
        assert [got[k, t] for t in range(len(v))] == [x if t in alive else None for t, x in enumerate(v)]
    assert got[9, 0] is None


def test_decluster_keeps_the_larger_peak(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 50, 9.0), (1, 100, 7.0), (1, 125, 6.0)], "s int, t long, v double")
    assert sorted(r.t for r in W.decluster(df, ["s"], "v", 72).collect()) == [50, 125]


def test_scalars(spark):
    assert value(spark, S.dress(F.lit(1.0), 0.3)) == pytest.approx(0.5, abs=1e-7)
    assert value(spark, S.phi(F.lit(1.3))) == pytest.approx(0.5 * (1 + math.erf(1.3 / math.sqrt(2))), abs=2e-7)
    assert [value(spark, S.areal_reduction(F.lit(a))) for a in (1.0, 1000.0, 1e9)] == pytest.approx([1.0, 0.8, 0.5])
    assert value(spark, S.duration_threshold(F.lit(20.0), F.lit(60.0), 12.0)) == pytest.approx(60)
    assert value(spark, S.runoff_coefficient(F.lit(300.0), 150.0, 150.0)) == pytest.approx(0.75)
    assert [value(spark, S.blend_weight(F.lit(x))) for x in (0.5, 2.5, 4.0)] == pytest.approx([1, 0.5, 0])
    assert value(spark, S.code_mm(F.lit(16.0))) == 32 and value(spark, S.code_probability(F.lit(0.4999))) == 99
    assert value(spark, S.storage_level(F.lit(9.0), 1.0, 2.0, 10.0)) == pytest.approx(13)
    assert value(spark, S.return_period(S.return_level(50.0, 50.0, 20.0, 0.1), 50.0, 20.0, 0.1)) == pytest.approx(50)
    assert [value(spark, S.parse_number(F.lit(x))) for x in ("12,3", "1.234,5", "1,234.5", "-", " 7 mm")] == [12.3, 1234.5, 1234.5, None, 7.0]


def test_special_functions(spark):
    assert [value(spark, special.gamma_function(F.lit(x))) for x in (0.3, 1.0, 4.5)] == pytest.approx([math.gamma(0.3), 1.0, math.gamma(4.5)], rel=1e-12)
    assert float(special.lower_gamma(1.0, 2.0)) == pytest.approx(1 - math.exp(-2))
    assert float(special.lower_gamma(0.5, 0.7)) == pytest.approx(math.erf(math.sqrt(0.7)))
    df = spark.createDataFrame([(0.3, 0.4, 0.0), (0.3, 0.4, 0.9999)], "p double, q double, r double")
    assert [r[0] for r in df.select(special.copula_union("p", "q", "r")).collect()] == pytest.approx([0.58, 0.4], abs=2e-3)


def test_levels(spark):
    df = spark.createDataFrame([(1, lv, p) for lv, p in zip((2, 3, 4, 5), (0.5, 0.1, 0.35, 0.0), strict=True)], "k int, level int, p double")
    assert E.decide(df, ["k"], {2: 0.15, 3: 0.30, 4: 0.30, 5: 0.40}).first().decided == 4
    a = spark.createDataFrame([(1, 1.0, 20.0, 60.0), (1, 3.0, None, None)], "k int, w double, a1 double, a12 double")
    p = [r.p for r in E.probabilities(a, ["k"], E.default_thresholds(), 0.5).orderBy("level").collect()]
    assert p[0] == pytest.approx(0.5, abs=1e-6) and p == sorted(p, reverse=True)


def test_neighbourhood_repeats_edges(spark):
    df = spark.createDataFrame([(0, j, i, float(10 * j + i)) for j in range(4) for i in range(3)], "k int, j int, i int, v double")
    off = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    got = {(r.j, r.i): r.around for r in G.neighbourhood(df, ["k"], "v", off, 4, 3, F.avg).collect()}
    for j in range(4):
        for i in range(3):
            want = sum(10 * min(max(j + a, 0), 3) + min(max(i + b, 0), 2) for a, b in off) / 9
            assert got[j, i] == pytest.approx(want)


def test_kriging_meets_its_points(spark):
    pts = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (0, 10.0, 0.0, 3.0), (0, 0.0, 20.0, 5.0)], "k int, y double, x double, v double")
    tgt = spark.createDataFrame([(0, 1, 10.0, 0.0), (0, 2, 500.0, 500.0)], "k int, id long, y double, x double")
    got = {r.id: r for r in G.krige(pts, tgt, ["k"], "v").collect()}
    assert got[1].estimate == pytest.approx(3.0, abs=1e-6) and got[1].variance < 1e-6 < got[2].variance


def test_kriging_solves_its_equations(spark):
    """Weights that sum to one and meet the variogram equations, whatever way they were found."""
    rng = np.random.default_rng(6)
    p, q = rng.uniform(0, 60, (7, 2)), np.vstack([rng.uniform(0, 60, (5, 2))])
    w, variance = G.kriging_weights(p, q, 40.0, 0.1)
    gamma = lambda d: np.where(d > 0, 0.1 + 0.9 * (1 - np.exp(-3 * d / 40)), 0.0)
    away = lambda a, b: np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    assert w.sum(axis=1) == pytest.approx(np.ones(5))
    rest = gamma(away(q, p)) - w @ gamma(away(p, p))  # the same multiplier for all points of a target
    assert rest == pytest.approx(np.repeat(rest[:, :1], 7, axis=1), abs=1e-6)
    assert variance == pytest.approx((w * gamma(away(q, p))).sum(axis=1) + rest[:, 0], abs=1e-6)


def test_gauges_are_judged_in_the_order_of_their_ids(spark):
    rng = np.random.default_rng(8)
    rows = [(k, i, float(rng.uniform(0, 30)), float(rng.uniform(0, 30)), float(rng.choice([0.0, 0.2, 12.0, 25.0, 31.0, 90.0, 400.0, -1.0, 1500.0])), rng.choice([None, 0.0, 16.0, 40.0])) for k in range(6) for i in range(25)]
    rows.append((7, 1, 0.0, 0.0, None, None))
    got = {(r.k, r.id): r.kept for r in G.gauge_check(spark.createDataFrame(rows, "k int, id long, y double, x double, v double, r double"), ["k"], "v", "r").collect()}
    kept = {(k, i): v is not None and 0 <= v < 1500 for k, i, _, _, v, _ in rows}
    for k, i, y, x, v, r in sorted(rows[:-1]):
        if kept[k, i] and (v < 0.5 or v > 30):
            near = [w for k2, i2, y2, x2, w, _ in rows[:-1] if k2 == k and i2 != i and kept[k, i2] and math.hypot(y - y2, x - x2) <= 15]
            if len(near) >= 2 and r is not None:
                kept[k, i] = not ((v < 0.5 and r >= 15 and np.median(near) >= 10) or (v > 30 and v > 3 * max(*near, r) + 20))
    assert got == kept and sum(not v for v in kept.values()) > 10


def test_a_river_that_flows_in_a_circle_is_an_error(spark):
    with pytest.raises(ValueError, match="cycle"):
        R.tree_sums(spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (4, 1, 1.0)], "n long, d long, v double"), "n", "d", "v")


def test_flow_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 3)], "src long, dst long")
    paths = R.closure(edges).cache()
    assert sorted((r.src, r.dst) for r in paths.collect()) == [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3), (4, 3), (4, 4)]
    nodes = spark.createDataFrame([(1, 5.0), (2, 3.0), (3, 2.0), (4, 1.0)], "n long, a double")
    assert rows(R.accumulate(paths, nodes, "n", "a"), "n") == [(1, 5.0), (2, 8.0), (3, 11.0), (4, 1.0)]
    got = R.tree_sums(edges.join(nodes, F.col("src") == F.col("n"), "left").select("src", "dst", "a"), "src", "dst", "a")
    assert rows(got, "src") == [(1, 5.0, 0), (2, 8.0, 1), (3, 11.0, 2), (4, 1.0, 0)]
    chain = spark.range(100).select(F.col("id").alias("n"), F.when(F.col("id") < 99, F.col("id") + 1).alias("d"), F.lit(1).alias("v"))
    assert all(r.v == r.n + 1 and r.level == r.n for r in R.tree_sums(chain, "n", "d", "v").collect())
    codes = spark.createDataFrame([("83", "81"), ("81", "83"), ("8112", "811"), ("820", "81")], "a string, b string")
    assert [r[0] for r in codes.select(R.is_upstream(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]


def test_scores(spark):
    e = [(True, True)] * 6 + [(False, True)] * 2 + [(True, False)] * 4
    c = V.contingency(spark.createDataFrame(e, "w boolean, e boolean"), [], F.col("w"), F.col("e")).first()
    assert (c.pod, c.far, c.csi, c.bias) == (0.75, 0.4, 0.5, 1.25)
    s = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "p double, e int")
    assert V.roc_area(s, [], "p", "e").first().auc == 0.75


def test_logistic_recovers_its_law(spark):
    df = spark.range(4000).select(((F.col("id") % 40) / 10 - 2).alias("x"), F.col("id"))
    df = df.withColumn("y", (F.pmod(F.xxhash64("id"), F.lit(10_000)) / 10_000 < S.logistic(0.5 + 1.5 * F.col("x"))).cast("int"))
    b = V.fit_logistic(df, ["x"], "y", ridge=1e-6)
    assert b == pytest.approx([0.5, 1.5], abs=0.15)


def test_l_moments_of_an_even_sample(spark):
    df = spark.createDataFrame([(1, float(x)) for x in range(1, 12)], "k int, v double")
    m = X.l_moments(df, ["k"], "v").first()
    assert (m.l1, m.l2, m.t3) == pytest.approx((6.0, 2.0, 0.0))


def test_as_of_and_runs(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 1)], "k int, t long")
    right = spark.createDataFrame([(1, 4, "a"), (1, 10, "b")], "k int, t long, v string")
    assert rows(J.as_of(left, right, ["k"], "v"), "k", "t") == [(1, 5, "a"), (1, 10, "b"), (2, 1, None)]
    issues, runs = spark.createDataFrame([(40,)], "t long"), spark.createDataFrame([(0,), (12,), (24,), (36,)], "run long")
    assert [r.run for r in J.runs_available(issues, runs, 7, 36, 3).orderBy("rank").collect()] == [24, 12]


def test_nearest_in_time_ties_nulls_and_empties(spark):
    from tessera.operators.joins import nearest_in_time

    left = spark.createDataFrame([("a", 10, "x"), ("a", 20, "y"), ("a", 40, None), ("b", 10, "z"), (None, 5, "n"), ("a", None, "t")], "s string, t int, c string")
    right = spark.createDataFrame([("a", 8, 1.0, 0), ("a", 12, 2.0, 0), ("a", 20, 3.0, 0), ("a", 20, 4.0, 0), ("a", 34, 5.0, 0), ("a", 41, None, 0), (None, 6, 6.0, 0)], "s string, t int, v double, c int")
    got = {(r.s, r.t): (r.c, r.near) for r in nearest_in_time(left, right, ["s"], "v", 5, "near").collect()}
    assert got == {("a", 10): ("x", 1.0), ("a", 20): ("y", 4.0), ("a", 40): (None, None), ("b", 10): ("z", None), (None, 5): ("n", 6.0), ("a", None): ("t", None)}
    assert {r.near for r in nearest_in_time(left, right.limit(0), ["s"], "v", 5, "near").collect()} == {None}
    assert not nearest_in_time(left.limit(0), right, ["s"], "v", 5).collect()


def test_daily_climate_of_few_nodes(spark):
    from tessera.operators.weighted import daily_climate

    nodes = [("one", 100, 7.0), ("two", 60, 0.0), ("two", 360, 6.0), ("two", 360, 6.0), ("two", 400, 9.0), ("two", 5, None)]
    got = {}
    for r in daily_climate(spark.createDataFrame(nodes, "s string, day int, q double"), ["s"], "q").collect():
        got.setdefault(r.s, {})[r.day] = r.q
    assert all(sorted(d) == list(range(366)) for d in got.values()) and set(got["one"].values()) == {7.0}
    for x in range(366):
        want = 6 * (x - 60) / 300 if 60 <= x <= 360 else 6 * (1 - ((x - 360) % 366) / 66)
        assert got["two"][x] == pytest.approx(want, abs=1e-12)


def test_inflow_scenarios_of_odd_dams(spark):
    from tessera.operators.hydrology import inflow_scenarios

    sim = [("m", d, t, 10.0, 2.0) for d in (1, 2, 3, 4, 5) for t in (0, 1, 2)] + [("late", 1, 2, 4.0, 1.0)]
    dams = [(1, 0, 16.0, 5.0, 4.0), (2, 0, None, 5.0, 4.0), (3, None, 1.0, 1.0, 1.0), (4, 0, 3.0, None, 2.0)]
    df = spark.createDataFrame(sim, "member string, dam int, t int, q double, w double")
    got = {(r.member, r.dam, r.t): (r.q, r.w) for r in inflow_scenarios(df, spark.createDataFrame(dams, "dam int, now int, seen double, release double, fade double"), "w", 0.4, 3).where("k = 1").collect()}
    e = lambda h, fade: math.exp(-(h - 0.5) / fade)
    want = {("m", 1, 1): 15 + e(1, 4), ("m", 1, 2): 15 + e(2, 4), ("late", 1, 2): 4 + 5 + 11 * e(2, 4), ("m", 2, 1): 10, ("m", 2, 2): 10, ("m", 4, 1): 10 - 7 * e(1, 2), ("m", 4, 2): 10 - 7 * e(2, 2)}
    assert {k: v[0] for k, v in got.items()} == pytest.approx(want) and got[("m", 1, 1)][1] == pytest.approx(2 / 3)
