"""The cover of polygons against the plain even-odd rule and plain distances."""

import math

import numpy as np
import pytest

from tessera.operators import polygons as P

RINGS = "poly int, rings array<array<struct<x:double,y:double>>>"


def star(rng, x, y, size, n):
    turn = np.sort(rng.uniform(0, 2 * math.pi, n))
    r = size * rng.uniform(0.4, 1.0, n)
    return [(float(x + a * math.cos(t)), float(y + a * math.sin(t))) for a, t in zip(r, turn)]


@pytest.fixture(scope="module")
def shapes():
    rng = np.random.default_rng(3)
    out = {k: [star(rng, *rng.uniform(-4, 4, 2), 2.0, 24)] for k in range(6)}
    out[0].append(star(rng, *np.mean(out[0][0], axis=0), 0.4, 9))  # a hole
    out[6] = [[(-9.0, -9.0), (9.0, -9.0), (9.0, 9.0), (-9.0, 9.0), (-9.0, -9.0)], [(-6.0, -6.0), (-6.0, 6.0), (6.0, 6.0), (6.0, -6.0)]]  # a frame, one ring closed
    out[7] = [[(7.0, 7.0), (8.0, 7.0), (8.0, 8.0)], [(-8.0, 7.0), (-7.0, 7.0), (-7.0, 8.0)]]  # two parts
    return out


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def apart(rings, x, y):
    best = math.inf
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            n = (x2 - x1) ** 2 + (y2 - y1) ** 2
            if n:
                t = min(max(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / n, 0), 1)
                best = min(best, math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)))
    return best


@pytest.mark.parametrize(("coarse", "levels"), [(1.0, 3), (5.0, 5), (0.7, 0)])
def test_locate_equals_the_plain_rules(spark, shapes, coarse, levels):
    rng = np.random.default_rng(5)
    pts = [(k, float(a), float(b)) for k, (a, b) in enumerate(rng.uniform(-13, 13, (400, 2)))]
    corners = [c for rings in shapes.values() for ring in rings for c in ring][:60]
    pts += [(1000 + k, *c) for k, c in enumerate(corners)] + [(2000 + k, float(a), float(b)) for k, (a, b) in enumerate(rng.integers(-10, 11, (60, 2)))]
    df = spark.createDataFrame([*pts, (5000, None, 1.0), (5001, float("nan"), 1.0)], "id long, x double, y double")
    index = P.cover(spark.createDataFrame(list(shapes.items()), RINGS), "poly", "rings", coarse, levels)
    got = {r.id: (r.poly, r.apart) for r in P.locate(df, index, "id", "x", "y").collect()}
    assert got.pop(5000) == (None, None) and got.pop(5001)[0] is None
    near = {r.id: r.poly for r in P.locate(df, index, "id", "x", "y", reach=0.8).collect()}
    for k, x, y in pts:
        holds = [p for p, rings in shapes.items() if inside(rings, x, y)]
        if holds:
            assert got[k] == (min(holds), 0.0) and near[k] == min(holds)
        else:
            d, p = min((round(apart(rings, x, y), 9), p) for p, rings in shapes.items())
            assert got[k][1] == pytest.approx(d, abs=1e-9) and apart(shapes[got[k][0]], x, y) == pytest.approx(d, abs=1e-8)
            assert near[k] == (got[k][0] if d <= 0.8 else None)
    every = {(r.id, r.poly) for r in P.containing(df.where("x = x and x is not null and id < 1000"), index, "id", "x", "y").collect()}
    assert every == {(k, p) for k, x, y in pts if k < 1000 for p, rings in shapes.items() if inside(rings, x, y)}


def test_inner_cells_are_kept_large(spark, shapes):
    index = P.cover(spark.createDataFrame([(6, shapes[6])], RINGS), "poly", "rings", 4.0, 5)
    rows = index.cells.collect()
    assert any(r.inside and r.level < 3 for r in rows) and all(r.level == 5 for r in rows if not r.inside)
    assert P.locate(spark.createDataFrame([], "id long, x double, y double"), index, "id", "x", "y").collect() == []


def test_no_polygons(spark):
    index = P.cover(spark.createDataFrame([], RINGS), "poly", "rings", 1.0, 2)
    df = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    assert [tuple(r) for r in P.locate(df, index, "id", "x", "y").collect()] == [(1, None, None)]
