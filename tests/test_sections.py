"""The bed beside a mapped line, slopes and sections, against a walk in numpy."""

import math

import numpy as np
import pytest

from tessera.operators import sections as S

T = S.Trace(reach=6, along=5, across=3, median=5, mean=3, near=2, pull=0.004, apart=20.0)
NY, NX = 60, 40


def ground(k, rng):
    """A valley that winds, falling with y (k even) or rising; some cells unknown."""
    y, x = np.mgrid[0:NY, 0:NX].astype(float)
    z = 0.4 * np.abs(x - 20 - 3 * np.sin(y / 9)) + (-1 if k % 2 == 0 else 1) * 0.05 * y + rng.uniform(0, 0.3, (NY, NX))
    z[rng.uniform(size=z.shape) < 0.01] = np.nan
    return z


def at(z, x, y):
    j, i = math.floor(y), math.floor(x)
    if not (0 <= j < NY - 1 and 0 <= i < NX - 1):
        return math.nan
    f, g = y - j, x - i
    return z[j, i] * (1 - f) * (1 - g) + z[j, i + 1] * (1 - f) * g + z[j + 1, i] * f * (1 - g) + z[j + 1, i + 1] * f * g


def clamp(v, k):
    return v[min(max(k, 0), len(v) - 1)]


def mean(v, size):
    return np.array([np.mean([clamp(v, k + d) for d in range(-(size // 2), size // 2 + 1)]) for k in range(len(v))])


def walk(z, chain, x, y):
    sx, sy = mean(x, T.along), mean(y, T.along)
    tx, ty = np.gradient(sx), np.gradient(sy)
    tx, ty = tx / np.hypot(tx, ty), ty / np.hypot(tx, ty)
    off = []
    for k in range(len(x)):
        p = np.array([at(z, x[k] + o * ty[k], y[k] - o * tx[k]) for o in range(-T.reach, T.reach + 1)])
        p = np.where(np.isnan(p), np.nanmax(p) if (~np.isnan(p)).any() else 0.0, p)
        cost = mean(p, T.across) + T.pull * np.abs(np.arange(-T.reach, T.reach + 1))
        off.append(float(np.argmin(np.round(cost, 12)) - T.reach))
    off = mean(np.array([np.median([clamp(off, k + d) for d in range(-(T.median // 2), T.median // 2 + 1)]) for k in range(len(off))]), T.mean)
    bx, by = x + off * ty, y - off * tx
    low = []
    for k in range(len(x)):
        near = [at(z, x[k] + (off[k] + d) * ty[k], y[k] - (off[k] + d) * tx[k]) for d in range(-T.near, T.near + 1)]
        near = [v for v in near if not math.isnan(v)]
        low.append(min(near) if near else math.nan)
    low = np.array(low)
    steep = [(low[b] - low[a]) / (chain[b] - chain[a]) for a in range(len(x)) for b in range(a + 1, len(x)) if chain[b] - chain[a] > T.apart and not math.isnan(low[a] + low[b])]
    turn = -1 if np.median(steep) > 0 else 1
    return turn * chain, bx, by, low, turn * tx, turn * ty


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(8)
    want, cells, stations, grids = {}, [], [], {}
    for k in range(3):
        z = grids[k] = ground(k, rng)
        cells += [(k, j, i, None if math.isnan(z[j, i]) else float(z[j, i])) for j in range(NY) for i in range(NX)]
        n = np.arange(50)
        chain, x, y = n * 12.0, 20 + rng.uniform(-0.5, 0.5, 50), 2 + n * 1.2
        stations += [(k, "a", int(a), float(b), float(c), float(d)) for a, b, c, d in zip(n, chain, x, y)]
        want[k] = walk(z, chain, x, y)
    stations += [(0, "single", 0, 0.0, 5.0, 5.0), (1, "still", 0, 0.0, 5.0, 5.0), (1, "still", 1, 1.0, 5.0, 5.0)]
    raster = spark.createDataFrame(cells, "field int, j int, i int, z double")
    traced = S.thalweg(spark.createDataFrame(stations, "field int, name string, n int, chain double, x double, y double"), raster, ["field", "name"], ["field"], T).persist()
    return grids, raster, traced, want


def test_bed_equals_a_walk(world):
    _, _, traced, want = world
    rows = {}
    for r in traced.orderBy("field", "n").collect():
        assert r.name == "a"
        rows.setdefault(r.field, []).append((r.chain, r.x, r.y, math.nan if r.z is None else r.z, r.tx, r.ty))
    assert set(rows) == set(want)
    for k in want:
        assert np.array(rows[k]) == pytest.approx(np.array(want[k]).T, abs=1e-9, nan_ok=True)
    assert {r.field: r.flipped for r in traced.select("field", "flipped").distinct().collect()} == {0: False, 1: True, 2: False}


def test_slopes_and_sections(spark, world):
    grids, raster, traced, want = world
    sections = [(k, "a", f"s{q}", float(sign * q)) for k, sign in ((0, 1), (1, -1), (2, 1)) for q in (0, 150, 406)] + [(0, "a", "far", 5000.0), (9, "a", "none", 0.0)]
    df = spark.createDataFrame(sections, "field int, name string, section string, at double")
    got = {(r.field, r.section, r.half): r.slope for r in S.bed_slopes(traced, df, ["field", "name"], (60.0, 250.0)).collect()}
    expected = {}
    for k, _, name, c in sections:
        for half in (60.0, 250.0):
            if k in want:
                chain, z = want[k][0], want[k][3]
                on = np.flatnonzero(np.abs(chain - c) <= half)
                pairs = [(z[b] - z[a]) / (chain[b] - chain[a]) for a in on for b in on if chain[b] - chain[a] > 20 and not math.isnan(z[a] + z[b])]
                if len(on) > 8 and pairs:
                    expected[(k, name, half)] = -float(np.median(pairs))
    assert got == pytest.approx(expected, abs=1e-9) and got and all(v > 0 for (_, _, half), v in got.items() if half > 100)
    profiles = {}
    for r in S.cut(traced, raster, df, ["field", "name"], ["field"], half=12, reach=500.0).orderBy("s").collect():
        profiles.setdefault((r.field, r.section), []).append((r.s, r.x, r.y, math.nan if r.z is None else r.z))
    assert set(profiles) == {(k, s) for k, _, s, _ in sections if k in want and s != "far"}
    for k, _, name, c in sections:
        if (k, name) in profiles:
            chain, bx, by, _, tx, ty = want[k]
            near = int(np.argmin(np.abs(chain - c)))
            line = [(bx[near] + o * ty[near], by[near] - o * tx[near]) for o in range(-12, 13)]
            full = [(o + 12.0, x, y, at(grids[k], x, y)) for o, (x, y) in zip(range(-12, 13), line)]
            assert np.array(profiles[(k, name)]) == pytest.approx(np.array(full), abs=1e-9, nan_ok=True)


def test_empty(spark, world):
    _, raster, _, _ = world
    none = spark.createDataFrame([], "field int, name string, n int, chain double, x double, y double")
    traced = S.thalweg(none, raster, ["field", "name"], ["field"], T)
    assert not traced.collect()
    assert not S.cut(traced, raster, spark.createDataFrame([], "field int, name string, section string, at double"), ["field", "name"], ["field"]).collect()
