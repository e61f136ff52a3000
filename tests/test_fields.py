"""Operators on whole fields against answers worked out by hand."""

import pytest

from tessera.operators import fields as X


def grid(spark, rows):
    return spark.createDataFrame([(0, j, i, float(v)) for j, r in enumerate(rows) for i, v in enumerate(r)], "k int, j int, i int, v double")


def test_low_is_as_deep_as_its_pass(spark):
    z = [[9, 9, 9, 9, 9], [9, 1, 9, 3, 9], [9, 9, 6, 9, 9], [9, 9, 9, 9, 9]]
    got = {(r.j, r.i): r.depth for r in X.closed_lows(grid(spark, z), ["k"], "v", 1).collect()}
    assert got == {(1, 1): 8.0, (1, 3): 3.0}


def test_depressions_fill_to_their_outlet(spark):
    z = [[5, 5, 5, 5], [5, 1, 1, 5], [5, 5, 4, 5]]
    got = {(r.j, r.i): r.filled for r in X.fill_depressions(grid(spark, z), ["k"], "v", 0.01).collect()}
    assert got[1, 1] == pytest.approx(4.01) and got[1, 2] == pytest.approx(4.01) and got[0, 0] == 5.0


def test_merging_meets_gauges_and_fills_holes(spark):
    radar = spark.createDataFrame([(0, j, i, None if (j, i) == (5, 5) else 4.0) for j in range(6) for i in range(6)], "k int, j int, i int, r double")
    at = [(0, 0), (0, 5), (3, 3), (5, 0), (2, 1)]
    gauges = spark.createDataFrame([(0, j, i, 9.0) for j, i in at], "k int, j int, i int, g double")
    got = {(r.j, r.i): r.merged for r in X.merge_gauges(radar, gauges, ["k"]).collect()}
    assert all(got[c] == pytest.approx(9.0, abs=1e-3) for c in at) and got[5, 5] == pytest.approx(9.0, abs=1e-3)
    few = {(r.j, r.i): r.merged for r in X.merge_gauges(radar, gauges.limit(3), ["k"]).collect()}
    assert few[1, 1] == pytest.approx(9.0)  # three pairs: the ratio of their sums


def test_tracks_take_the_nearest(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 1, 10.0, 0.0), (0, 2, 1.0, 0.0), (0, 2, 9.5, 0.0), (0, 9, 1.0, 0.0)], "k int, t long, y double, x double")
    rows = {(r.t, r.y): r.track for r in X.link_tracks(df, ["k"], 3.0, 2).collect()}
    assert rows[2, 1.0] == rows[1, 0.0] and rows[2, 9.5] == rows[1, 10.0] and rows[9, 1.0] not in (0, 1)


def test_parcel_of_a_stable_column_has_no_energy(spark):
    stable = [(0, 1000.0 - 50 * k, 10.0 + k, 0.0) for k in range(10)]
    loaded = [(1, 1000.0 - 50 * k, 30.0 - 6.5 * k, 24.0 - 8 * k) for k in range(16)]
    got = {r.k: r for r in X.parcel_indices(spark.createDataFrame(stable + loaded, "k int, p double, temp double, dewpoint double"), ["k"]).collect()}
    assert got[0].cape == 0.0 and got[1].cape > 500 and 850 < got[1].lcl < 1000
