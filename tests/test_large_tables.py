"""What larger tables and odd places brought to light: joins that must not be broadcast, dense neighbours, edges, short lines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators import grids as G
from tessera.operators import matching as M
from tessera.operators import polygons as P
from tessera.operators import sections as S
from tessera.plans import all_queries


def test_registration_sends_no_moved_gauges_to_the_driver(spark):
    radar = spark.range(200).selectExpr("0 as k", "cast(id / 10 as int) as j", "cast(id % 10 as int) as i", "double(id % 7) as r")
    found = G.register(radar, radar.withColumnRenamed("r", "g"), ["k"], 20, 10, 2)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().toString()
    assert found.count() == 1


def test_dense_neighbours_are_found_in_rounds(spark):
    rng = np.random.default_rng(3)
    p, o = rng.uniform([38, -1], [38.6, -0.4], (40, 2)), rng.uniform([38, -1], [38.6, -0.4], (900, 2))
    o[:30], o[30:60], p[0], p[1] = o[0], o[30] + 1e-9, o[0], (39.5, 1.0)
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "id long, lat double, lon double")
    others = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(o)], "oid long, olat double, olon double")
    found = G.nearest_points(points, others, 5, 40.0)
    assert "ExistingRDD" in found._jdf.queryExecution().toString()  # some were settled within less than the radius
    got = {(r["id"], r["rank"]): r["oid"] for r in found.collect()}
    want = {}
    for i, (lat, lon) in enumerate(p):
        km = 6371.0 * np.sqrt((np.radians(o[:, 1] - lon) * np.cos(np.radians((lat + o[:, 0]) / 2))) ** 2 + np.radians(o[:, 0] - lat) ** 2)
        near = sorted((d, k) for k, d in enumerate(km.tolist()) if d <= 40)[:5]
        want |= {(i, n + 1): k for n, (_, k) in enumerate(near)}
    assert got == want and not any(i == 1 for i, _ in got)


def test_points_of_edges_are_outside(spark):
    ring = "array(struct(0D as x, 0D as y), struct(1D as x, 0D as y), struct(1D as x, 1D as y), struct(0D as x, 1D as y), struct(0D as x, 0D as y))"
    sides = "array(struct(1D as a, 0D as b, 0D as c), struct(-1D as a, 0D as b, -1D as c), struct(0D as a, 1D as b, 0D as c), struct(0D as a, -1D as b, -1D as c))"
    points = [(0.5, 0.5, True), (0.0, 0.5, False), (0.5, 0.0, False), (1.0, 0.5, False), (0.5, 1.0, False), (1e-12, 0.5, True), (0.5, 2.0, False)]
    df = spark.createDataFrame(points, "x double, y double, want boolean")
    got = df.select("want", geo.in_open_ring(F.col("x"), F.col("y"), F.expr(ring), F.expr(sides)).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_short_lines_turn_if_no_number_of_heights_is_asked_for(spark):
    rows = spark.createDataFrame([("up", float(n), float(n)) for n in range(4)] + [("down", float(n), -float(n)) for n in range(4)], "line string, chain double, z double")
    climbs = lambda least: {r["line"]: r["climbs"] for r in S._climbs(rows, ["line"], 0.0, least).collect()}
    assert climbs(0) == {"up": True, "down": False} and climbs(5) == {"up": False, "down": False}


def test_many_cells_bring_their_edges_and_are_not_broadcast(spark, monkeypatch):
    frame = [[(-3.0, -3.0), (3.0, -3.0), (3.0, 3.0), (-3.0, 3.0)], [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]]
    index = P.cover(spark.createDataFrame([(1, frame)], "poly int, rings array<array<struct<x:double,y:double>>>"), "poly", "rings", 2.0, 3)
    points = [(0, 0.0, 0.0), (1, 2.0, 0.3), (2, 0.99, 0.0), (3, 1.01, 0.0), (4, 2.99, 2.99), (5, 3.01, 0.0), (6, None, 0.0)]
    monkeypatch.setattr(P, "MOST_CELLS", 0)
    found = P.containing(spark.createDataFrame(points, "id long, x double, y double"), index, "id", "x", "y")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().toString()
    assert sorted(r["id"] for r in found.collect()) == [1, 3, 4]


def test_equal_names_are_matched_once_and_not_broadcast(spark):
    names = spark.createDataFrame([(1, i, "Red Bolt") for i in range(4)] + [(1, 9, "red-bolt"), (2, 4, "red bolt")], "k int, id long, text string")
    register = spark.createDataFrame([(1, 7, "red bolt", "x"), (1, 3, "Red  bolt", "X"), (1, 5, "blue ring", "x")], "k int, station long, name string, place string")
    found = M.match_names(names, register, ["k"])
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().toString()
    assert sorted((r["k"], r["id"], r["station"]) for r in found.collect()) == [(1, i, 3) for i in (0, 1, 2, 3, 9)]


@pytest.mark.parametrize("name", ["bilinear_sample", "snap_to_maximum"])
def test_every_place_is_sought_in_every_field(spark, name):
    got = all_queries()[name](spark, "/root/testdata/sf0.01")
    assert got.count() == got.select("plane").distinct().count() * got.select("id").distinct().count() == 10 * 100


def test_a_case_is_one_row_and_only_sums_are_shuffled(spark):
    from tessera.operators import calibrate as C

    grid = C.Grid(0.1, 8.0, 7)
    cases = spark.range(400).selectExpr("id % 3 as `group`", "1D as w", "5D + id as obs")
    left = lambda df: C.with_profiles(df, F.array(F.lit(2.0), F.lit(0.5), F.lit(2.0)), F.array(F.col("obs") * 3, F.col("obs"), F.lit(0.0)), F.col("obs"), F.lit(0.0), F.lit(False), grid)
    assert left(cases).count() == 400
    plan = C.curves(left, cases, ["group"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    x = np.linspace(np.log(0.1), np.log(8.0), 7)
    want = np.interp(x, np.log([0.5, 2.0]), [0.0, np.log(3.0)])
    got = {r["group"]: (r["n"], [v / C.UNIT for v in r["loss"]]) for r in C.curves(left, cases, ["group"]).collect()}
    assert {g: n for g, (n, _) in got.items()} == {0: 134, 1: 133, 2: 133}
    assert all(loss == pytest.approx(list(want * n), abs=1e-5) for n, loss in got.values())


def test_ranks_come_by_ranges_of_values(spark):
    from tessera.operators import verify as V

    rows = [(k, x, y) for k, x, y in zip([None, 1, 1, 1, None, 1, None, None], [3.0, 1.0, 1.0, None, 3.0, 2.0, 5.0, 1.0], [1.0, 2.0, 2.0, 9.0, 4.0, 5.0, 6.0, 1.0])]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    below = {(r["k"], r["x"]): (r["n_"], r["below_"]) for r in V.counted_below(df, ["k"], "x").collect()}
    assert below == {(None, 1.0): (1, 0), (None, 3.0): (2, 1), (None, 5.0): (1, 3), (1, None): (1, 0), (1, 1.0): (2, 1), (1, 2.0): (1, 3)}
    got = V.rank_correlation(df, ["k"], "x", "y")
    assert "ExistingRDD" in got._jdf.queryExecution().toString()  # counted values, not a window of all rows
    rank = lambda v: [sum(a < b for a in v) + (sum(a == b for a in v) + 1) / 2 for b in v]
    for r in got.collect():
        mine = [((-1.0 if x is None else x), y) for k, x, y in rows if k == r["k"]]
        assert r["n"] == 4 and r["spearman"] == pytest.approx(np.corrcoef(rank([m[0] for m in mine]), rank([m[1] for m in mine]))[0, 1])


def test_features_are_ranked_by_counts(spark):
    from tessera.operators import verify as V

    rows = [(z, g, float((7 * n + g) % 6)) for z in (0, 1) for g in range(3) for n in range(15 + g)]
    df = spark.createDataFrame(rows, "z int, g int, v double")
    found = V.feature_rank(df, df, ["z"], "g", "v")
    got = {(r["z"], r["g"], r["v"]): r["rank"] for r in found.collect()}
    assert "ExistingRDD" in found._jdf.queryExecution().toString()  # counted values, not a window of all rows
    for z, g, v in rows:
        others = [w for y, h, w in rows if y == z and h != g]
        assert got[z, g, v] == pytest.approx((sum(w < v for w in others) + sum(w == v for w in others) / 2) / len(others))


def test_chains_are_settled_by_unit_and_dense_points_in_rounds(spark):
    from tessera.operators import products

    places = spark.createDataFrame([(1, 5, 38.0, -1.0), (2, 7, 38.0, -1.0), (3, 7, 39.0, -1.0), (4, 6, 38.0, -1.0)], "id long, unit long, lat double, lon double")
    chains = spark.createDataFrame([(5, 5, 0), (5, 2, 1), (7, 7, 0), (6, 6, 0), (6, 2, 1)], "unit long, below long, steps int")
    points = spark.createDataFrame([(i, 5 if i < 100 else 2 if i < 200 else 90, 38.0 + i % 50 * 1e-4, -1.0) for i in range(2000)], "pt long, unit long, lat double, lon double")
    found = products.first_below(places, chains, points)
    assert "ExistingRDD" in found._jdf.queryExecution().toString()  # near points are sought in rounds
    assert {r["id"]: (r["pt"], r["by"]) for r in found.collect()} == {1: (0, "chain"), 2: (0, "near"), 3: (None, None), 4: (100, "chain")}


def test_trials_of_a_level_volume_law_are_not_shuffled(spark):
    from tessera.operators import hydrology as H

    df = spark.range(40).selectExpr("1 as k", "10 + id / 10 as h", "2 * pow(1 + id / 10, 2D) as v")
    found = H.fit_level_volume(df, ["k"], "h", "v")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert found.first()["b"] == pytest.approx(2, abs=0.1)


def test_ranks_of_a_climate_are_those_of_counted_values(spark):
    plan = all_queries()["climate_rank_feature"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "LogicalRDD" in plan  # values were counted; no row is joined to its rank


def test_members_of_an_index_are_counted_and_not_sorted(spark):
    from tessera.operators import ensemble as E

    members = spark.range(4000).selectExpr("id % 2 as k", "double(id % 7) as v")
    climate = spark.createDataFrame([(k, p, q) for k in (0, 1) for p, q in ((0.1, 0.0), (0.5, 3.0), (0.9, 6.0))], "k long, p double, q double")
    found = E._shares(members, climate, ["k"], "v")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and plan.index("ShuffledHashJoin") < plan.rindex("partial_count(1)")
    assert {(r["k"], r["p"]): round(r["f"], 2) for r in found.collect()} == {(k, p): f for k in (0, 1) for p, f in ((0.1, 0.14), (0.5, 0.57), (0.9, 1.0))}


def test_a_law_is_fitted_by_as_many_tasks_as_its_rows_ask_for(spark, monkeypatch):
    from tessera.functions.special import lower_gamma
    from tessera.operators import emos as E

    seen, scores = [], E.trial_scores
    monkeypatch.setattr(E, "trial_scores", lambda rows, trials: seen.append(rows.rdd.getNumPartitions()) or scores(rows, trials))
    monkeypatch.setattr(E, "TASK_ROWS", 100)
    df = spark.range(0, 1000, 1, 1).selectExpr("1 + id % 7 as m", "2 + id % 9 as q", "id % 8 as y")
    assert E.fit(df, "m", "q", "y", rounds=2) is not None and seen == [10, 10, 10]
    a, x = np.array([0.3, 2.0, 50.0, 4000.0, 4000.0, 2.0]), np.array([1e-9, 700.0, 51.0, 4000.0, 4100.0, 0.0])  # slow and fast ones
    assert list(lower_gamma(a, x)) == [pytest.approx(float(lower_gamma(*v)), abs=1e-12) for v in zip(a, x)]
    assert float(lower_gamma(1.0, 2.0)) == pytest.approx(1 - np.exp(-2))


def test_a_climate_of_days_meets_only_runs_with_its_order_statistics(spark, monkeypatch):
    from tessera.operators import weighted as W

    rng = np.random.default_rng(5)
    rows = [(k, None if d == 40 else d, float(v) if v > 2 else None) for k in (1, None) for d, v in zip(rng.integers(1, 41, 400).tolist(), rng.integers(0, 60, 400).tolist())]
    df = spark.createDataFrame(rows, "k int, d int, v double").repartition(4)
    monkeypatch.setattr(W, "RUN", 8)
    found = W.circular_climatology(df, ["k"], "d", "v", 3, {"low": 0.0, "p50": 0.5, "p93": 0.93, "top": 1.0}, 39)
    assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["k"], r["doy"]): r for r in found.collect()}
    assert len(got) == 2 * 40
    for (k, doy), r in got.items():
        own = [v for j, d, v in rows for e in range(-3, 4) if v is not None and j == k and (None if d is None else (d - 1 + e + 39) % 39 + 1) == doy]
        assert r["n"] == len(own) and [r[c] for c in ("low", "p50", "p93", "top")] == pytest.approx(list(np.quantile(own, [0, 0.5, 0.93, 1])))
    assert W.circular_climatology(df.limit(0), [], "d", "v", 3, {"p50": 0.5}).collect() == []


def test_equal_heights_of_a_bed_rise_as_in_its_sql(spark, tmp_path):
    import duckdb

    from tessera.plans import all_sql

    sizes = [int(v) for seed in (47, 851, 1629, 2185) for v in np.random.default_rng(seed).integers(1, 51, 200)]  # as many rises as falls, but for the last bits
    part = spark.createDataFrame(list(enumerate(sizes)), "p_partkey long, p_size int")
    part.repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet') ORDER BY p_partkey")
    want = con.sql(all_sql()["river_beds"])
    got = all_queries()["river_beds"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_no_side_of_a_bed_is_broadcast(spark, monkeypatch):
    plans, durable = [], S.durable

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return durable(df)

    monkeypatch.setattr(S, "durable", seen)
    raster = spark.range(60).selectExpr("0 as plane", "cast(id / 10 as int) as j", "cast(id % 10 as int) as i", "double(id % 7) as z")
    stations = spark.range(8).selectExpr("0 as plane", "int(id) as n", "double(id) as chain", "4.5D as x", "id / 2D as y")
    found = S.thalweg(stations, raster, ["plane"], ["plane"], S.Trace(reach=2, along=3, across=3, median=3, mean=3, near=1, known=0))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 3 and not any("Broadcast" in p for p in plans) and all("SortMergeJoin" in p for p in plans)
    assert found.count() == 8
