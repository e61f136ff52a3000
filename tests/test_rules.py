"""Operators against the rules they state, worked through in plain Python step by step."""

from __future__ import annotations

import datetime
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ensemble as E
from tessera.operators import fields as X
from tessera.operators import grids as G
from tessera.operators import hydrology as Y
from tessera.operators import products as P
from tessera.operators import windows as W
from tessera.streaming import operators as S


def share(wet, p0, s):
    x = max(wet - p0, 0.0)
    return x * (x + 2 * s) / (x + s) ** 2


def test_net_rain_hour_by_hour(spark):
    """Also over hours without rain, and over several blocks of the fading sum."""
    rng = np.random.default_rng(1)
    loss = Y.Loss(memory=3.0, p0=40.0, s=60.0, phi=20.0)
    rain = {int(t): float(x) for t, x in zip(np.sort(rng.choice(900, 300, replace=False)), rng.gamma(0.5, 30.0, 300), strict=True)}
    got = {r.t: r for r in Y.net_rain(spark.createDataFrame([(1, t, x) for t, x in rain.items()], "k int, t long, rain double"), ["k"], "rain", loss).collect()}
    wet = 0.0
    assert sorted(got) == list(range(min(rain), max(rain) + 1))
    for t in sorted(got):
        p = rain.get(t, 0.0)
        middle = 0.5 * (wet * math.exp(-1 / 3.0) + wet * math.exp(-1 / 3.0) + p)
        wet = wet * math.exp(-1 / 3.0) + p
        c = share(middle, loss.p0, loss.s)
        e = p * c + (1 - c) * max(p - loss.phi, 0)
        e = (1 - loss.alpha) * e + loss.alpha * p * share(middle, loss.p0b, loss.sb)
        assert got[t].wetness == pytest.approx(wet, rel=1e-9, abs=1e-9) and got[t].net == pytest.approx(e, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize(("wet", "rain", "net"), [(300.0, 80.0, 72.08), (0.0, 5.0, 0.08)])
def test_net_rain_at_known_points(spark, wet, rain, net):
    """The wetness at mid-hour is wet; 72.08 of 80 mm run off soaked ground, and next to nothing of 5 mm off dry ground."""
    x = spark.range(1).select(Y.net_of(F.lit(wet * math.exp(-1 / 72.0) + rain), F.lit(rain), Y.Loss()).alias("x")).first().x
    middle = wet * math.exp(-1 / 72.0) + rain / 2
    c, cb = share(middle, 150.0, 150.0), share(middle, 10.0, 100.0)
    assert x == pytest.approx(0.984 * (rain * c + (1 - c) * max(rain - 40, 0)) + 0.016 * rain * cb)


def test_linear_store_step_by_step(spark):
    inflow = {0: 5.0, 1: 2.0, 40: 7.0, 500: 1.0}
    got = {r.t: r.routed for r in Y.linear_store(spark.createDataFrame([(1, t, x) for t, x in inflow.items()], "k int, t long, q double"), ["k"], "q", 2.0).collect()}
    q, c = 0.0, 1 - math.exp(-0.5)
    for t in range(501):
        q += c * (inflow.get(t, 0.0) - q)
        assert got[t] == pytest.approx(q, rel=1e-9, abs=1e-12)


def test_forecast_index_by_hand(spark):
    rng = np.random.default_rng(2)
    ps = [0.05, 0.2, 0.5, 0.8, 0.95]
    climate = {k: np.sort(rng.gamma(1.0, 8.0, 5)) for k in range(4)}
    members = {k: np.round(rng.gamma(1.0, 10.0, 30), 1) for k in range(4)}
    m = spark.createDataFrame([(k, float(x)) for k, v in members.items() for x in v], "k int, v double")
    c = spark.createDataFrame([(k, p, float(q)) for k, v in climate.items() for p, q in zip(ps, v, strict=True)], "k int, p double, q double")
    got, closed = ({r.k: r.efi for r in f.collect()} for f in (E.forecast_index(m, c, ["k"], "v"), E.closed_forecast_index(m, c, ["k"], "v", wet=5.0)))
    for k in range(4):
        f = [np.mean(members[k] <= q) for q in climate[k]]
        y = [(p - x) / math.sqrt(p * (1 - p)) for p, x in zip(ps, f, strict=True)]
        want = 2 / math.pi * sum((a + b) / 2 * (q - p) for a, b, p, q in zip(y[:-1], y[1:], ps[:-1], ps[1:], strict=True))
        assert got[k] == pytest.approx(min(max(want, -1), 1), abs=1e-9)
        # the closed form against a fine sum of the same integral
        pp, ff, qq = [0.0, *ps, 1.0], [f[0], *f, f[-1]], [climate[k][0], *climate[k], climate[k][-1]]
        top = full = 0.0
        for i in range(len(pp) - 1):
            if qq[i + 1] > 5.0:
                angle = np.linspace(math.asin(math.sqrt(pp[i])), math.asin(math.sqrt(pp[i + 1])), 20_001)
                p = np.sin(angle) ** 2
                line = ff[i] + (ff[i + 1] - ff[i]) * (p - pp[i]) / (pp[i + 1] - pp[i])
                top, full = top + 2 * np.trapezoid(p - line, angle), full + 2 * np.trapezoid(p, angle)
        assert (closed[k] is None and full == 0) or closed[k] == pytest.approx(min(max(top / full, -1), 1), abs=1e-6)


def test_median_leaves_both_ends(spark):
    df = spark.createDataFrame([(1, t, x) for t, x in enumerate([9.0, 1.0, 5.0, 2.0, 8.0])], "k int, t long, v double")
    assert [r.m for r in W.median3(df, ["k"], "v", "m").orderBy("t").collect()] == [9.0, 5.0, 2.0, 5.0, 8.0]


def test_gauges_are_judged_one_after_the_other(spark):
    rows = [(0, 0.0, 0.0, 0.0, 40.0), (1, 1.0, 0.0, 12.0, 10.0), (2, 0.0, 1.0, 14.0, 10.0), (3, 1.0, 1.0, 200.0, 20.0), (4, 90.0, 0.0, 0.0, 40.0), (5, 2.0, 0.0, -1.0, 1.0), (6, 0.5, 0.5, 0.0, None)]
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, id int, y double, x double, v double, r double")
    kept = {r.id: r.kept for r in G.gauge_check(df, ["k"], "v", "r").collect()}
    # dry under heavy radar; a dump; a negative one; a dry one far from all, and one that the radar does not see, stay
    assert kept == {0: False, 1: True, 2: True, 3: False, 4: True, 5: False, 6: True}


def test_echoes_grow_with_their_surroundings(spark):
    z = np.full((9, 9), 5.0)
    z[4, 4] = 55.0
    z[3:6, 3:6] = np.maximum(z[3:6, 3:6], 35.0)
    z[4, 7], z[0, 0] = 20.0, 20.0
    df = spark.createDataFrame([(1, j, i, float(z[j, i])) for j in range(9) for i in range(9)], "k int, j int, i int, v double")
    got = {(r.j, r.i) for r in G.convective(df, ["k"], "v", 9, 9, 1, 1).collect() if r.convective}
    pad = np.pad(10 ** (np.maximum(z, 0) / 10), 1, mode="edge")
    mean = 10 * np.log10(sum(pad[a : a + 9, b : b + 9] for a in range(3) for b in range(3)) / 9)
    margin = np.where(mean < 42.43, 10 - mean**2 / 180, 0)
    want = set()
    for j in range(9):
        for i in range(9):
            if z[j, i] >= 40 or (z[j, i] - mean[j, i] >= margin[j, i] and z[j, i] >= 25):
                reach = int(min(max(1 + (mean[j, i] - 25) / 5, 1), 5)) - 1
                want |= {(a, b) for a in range(9) for b in range(9) if abs(a - j) + abs(b - i) <= reach and z[a, b] >= 15}
    assert got == want and (4, 4) in got and (0, 0) not in got


def test_specks_and_clutter(spark):
    rows = [(0, 0, 35.0, False), (0, 1, 13.0, False), (2, 0, 14.0, False), (4, 4, 50.0, True), (5, 5, 31.0, False), (5, 6, 12.0, False), (6, 5, 12.0, False), (6, 6, 12.0, False), (8, 8, 11.0, False)]
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, j int, i int, v double, static boolean")
    got = {(r.j, r.i): r.clean for r in G.despeckle(df, ["k"], "v", clutter="static").collect()}
    # a strong pair goes, a weak cell and four connected ones stay, clutter is unknown
    assert got == {(0, 0): -32.0, (0, 1): -32.0, (2, 0): 14.0, (4, 4): None, (5, 5): 31.0, (5, 6): 12.0, (6, 5): 12.0, (6, 6): 12.0, (8, 8): 11.0}


def test_merged_field_meets_its_gauges(spark):
    field = spark.createDataFrame([(1, j, i, float(j + i)) for j in range(6) for i in range(6)], "k int, j int, i int, r double")
    gauges = spark.createDataFrame([(1, j, i, g) for j, i, g in ((0, 0, 4.0), (0, 5, 9.0), (5, 0, 2.0), (5, 5, 16.0), (2, 3, 1.0))], "k int, j int, i int, g double")
    got = {(r.j, r.i): r.merged for r in X.merge_gauges(field, gauges, ["k"]).collect()}
    assert [got[p] for p in ((0, 0), (0, 5), (5, 0), (5, 5), (2, 3))] == pytest.approx([4.0, 9.0, 2.0, 16.0, 1.0], abs=1e-4)
    few = {(r.j, r.i): r.merged for r in X.merge_gauges(field, gauges.limit(2), ["k"], usual=2.0).collect()}
    assert few[3, 3] == pytest.approx(12.0)  # fewer than three pairs: the usual factor


def test_level_volume_fit_recovers_its_law(spark):
    h = [100 + 0.05 * k for k in range(60)]
    rows = [(1, x, 0.5 * (x - 98.0) ** 2.0) for x in h for _ in range(3)] + [(1, h[30], 50.0)] + [(2, 100.0, 1.0), (2, 100.1, 1.1)]
    got = Y.fit_level_volume(spark.createDataFrame(rows, "k int, h double, v double"), ["k"], "h", "v").collect()
    assert len(got) == 1 and got[0].k == 1 and got[0].rms < 0.02 and got[0].b == pytest.approx(2.0, abs=0.1) and got[0].clipped is None
    flat = [(1, x, min(v, 3.0)) for _, x, v in rows[:-3]]
    got = Y.fit_level_volume(spark.createDataFrame(flat, "k int, h double, v double"), ["k"], "h", "v").first()
    assert got.clipped == pytest.approx(3.0) and got.n < 60


def test_windows_of_a_stream_are_right_closed_and_drop_late_rows(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2024, 1, 5, h, m)
    schema = "k string, ts timestamp, v long"
    source = str(tmp_path / "in")
    # files are read one at a time; rows are late by the watermark that held when the batch before theirs began
    for n, rows in enumerate(([("a", at(1), 1), ("a", at(1, 1), 2)], [("a", at(9), 4)], [("a", at(10), 32)], [("a", at(1), 8), ("a", at(10, 30), 16)], [("a", at(20), 64)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{source}/*")
    out = S.tumbling(stream, ["k"], "ts", "1 hour", [F.sum("v").alias("v")], late="1 hour")
    folder = S.run_once(out, "append")
    got = {(r.t.hour, r.v) for r in spark.read.parquet(folder).collect()}
    # 01:00 belongs to the hour that ends then; what came for it after the watermark had passed is left out
    assert (1, 1) in got and (2, 2) in got and not any(v == 9 for _, v in got)
    batch = spark.createDataFrame([("a", at(1), 1), ("a", at(1, 1), 2)], schema)
    assert {(r.t.hour, r.v) for r in S.tumbling(batch, ["k"], "ts", "1 hour", [F.sum("v").alias("v")]).collect()} == {(1, 1), (2, 2)}
    assert {r.t.hour for r in S.sliding(batch, ["k"], "ts", "2 hours", "1 hour", [F.sum("v").alias("v")]).where("v = 1").collect()} == {1}


def test_nested_thresholds_leave_their_case_out(spark):
    rng = np.random.default_rng(7)
    rows = [(c, round(float(p), 2), bool(rng.random() < p * (0.5 + c / 6)), 1.0 + c) for c in range(4) for p in rng.random(60)]
    taus = [0.1, 0.3, 0.5, 0.7]
    got = {r.c: r.tau for r in P.nested_threshold(spark.createDataFrame(rows, "c int, p double, e boolean, w double"), "c", "p", "e", "w", taus).collect()}
    for c in range(4):
        csi = []
        for t in taus:
            rest = [(p >= t, e, w) for k, p, e, w in rows if k != c]
            h, m, a = (sum(w for x, e, w in rest if ok(x, e)) for ok in (lambda x, e: x and e, lambda x, e: not x and e, lambda x, e: x and not e))
            csi.append(h / (h + m + a))
        assert got[c] == max(t for t, x in zip(taus, csi, strict=True) if x >= max(csi) - 0.005)


def test_theil_sen_is_a_median_of_slopes(spark):
    pts = [(0.0, 1.0), (1.0, 3.5), (2.0, 4.0), (5.0, 30.0)]
    got = Y.theil_sen(spark.createDataFrame([(1, *p) for p in pts], "k int, x double, y double"), ["k"], "x", "y").first()
    slopes = [(b[1] - a[1]) / (b[0] - a[0]) for i, a in enumerate(pts) for b in pts[i + 1 :]]
    assert got.slope == pytest.approx(statistics.median(slopes))
