"""The score in closed form against its integral, and laws that are found again from their own draws."""

import math

import numpy as np
import pytest

from tessera.functions.special import lower_gamma
from tessera.operators import emos as E


def test_score_equals_its_integral():
    rng = np.random.default_rng(1)
    x = (np.arange(400_000) + 0.5) * 1e-3
    for _ in range(12):
        shape, scale, shift = rng.uniform(0.1, 4), rng.uniform(0.3, 8), -rng.uniform(0, 3)
        for y in (0.0, float(rng.gamma(shape) * scale)):
            f = lower_gamma(np.full(len(x), shape), (x - shift) / scale)
            want = ((f - (x >= y)) ** 2).sum() * 1e-3
            got = E.crps(np.array([y]), np.array([shape]), np.array([scale]), shift)[0]
            assert got == pytest.approx(want, rel=3e-3, abs=2e-3)


def drawn(rng, law, n):
    m = rng.gamma(0.6, 8.0, n)
    q = m * rng.uniform(1.0, 3.0, n)
    shape, scale = law.shape_scale(m, q)
    return m, q, shape, scale


def test_a_law_is_found_again(spark):
    rng, law = np.random.default_rng(2), E.Law(0.4, 0.8, 0.1, 0.7, 0.3, -0.6)
    m, q, shape, scale = drawn(rng, law, 3000)
    y = np.maximum(rng.gamma(shape) * scale + law.shift, 0)
    rows = [tuple(map(float, r)) for r in zip(m, q, y)] + [(None, 1.0, 1.0), (1.0, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "m double, q double, y double").repartition(4)
    found, score, raw = E.fit(df, "m", "q", "y", rounds=35)
    own = float(E.crps(y, shape, scale, law.shift).mean())
    assert score <= own * 1.001 and score < raw == pytest.approx(float(np.abs(m - y).mean()))
    grid = np.array([0.5, 3.0, 12.0, 40.0])
    for a, b in zip(found.shape_scale(grid, 2 * grid), law.shape_scale(grid, 2 * grid)):
        assert a == pytest.approx(b, rel=0.35)
    assert E.fit(df.limit(0), "m", "q", "y") is None


def test_correlation_of_two_outcomes(spark):
    rng, law = np.random.default_rng(3), E.Law(0.4, 0.8, 0.1, 0.7, 0.3, -0.2)
    m, q, shape, scale = drawn(rng, law, 1500)
    z = rng.multivariate_normal([0, 0], [[1, 0.6], [0.6, 1]], 1500)
    sides = []
    for k in (0, 1):
        p = np.array([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in z[:, k]])
        lo, hi = np.zeros(1500), np.full(1500, 200.0)
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = np.where(lower_gamma(shape, mid) < p, mid, lo), np.where(lower_gamma(shape, mid) < p, hi, mid)
        sides.append(np.maximum(hi * scale + law.shift, 0))
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(m, q, *sides)], "m double, q double, y1 double, y2 double")
    args = (law, "m", "q", "y1"), (law, "m", "q", "y2")
    assert E.copula_correlation(df, *args) == pytest.approx(0.6, abs=0.12)
    assert E.copula_correlation(df.limit(9), *args) == 0.7
