"""The motion of fields: patterns that were moved by a known amount, and the equations solved in numpy."""

import numpy as np
import pytest

from tessera.operators import motion as M

FIELD = "k int, t int, j int, i int, v double"


def rows_of(k, fields):
    return [(k, t, j, i, None if np.isnan(x) else float(x)) for t, f in enumerate(fields) for (j, i), x in np.ndenumerate(f)]


def blobs(ny, nx, dj, di, steps, seed):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:ny, :nx]
    at = rng.uniform(-5, 45, (14, 2))
    return [sum(8 * np.exp(-((y - a - t * dj) ** 2 + (x - b - t * di) ** 2) / 18) for a, b in at) for t in range(steps)]


def test_moved_patterns_are_followed(spark):
    cases = {0: (1.0, -2.0), 1: (4.0, 3.0), 2: (0.0, 0.0)}
    rows = [r for k, v in cases.items() for r in rows_of(k, blobs(40, 36, *v, 3, k))]
    rows += rows_of(8, [np.zeros((40, 36))] * 2) + rows_of(9, blobs(40, 36, 1, 1, 1, 9))  # dry, and one scan
    got = M.motion(spark.createDataFrame(rows, FIELD), ["k"], "t", "v", 40, 36).collect()
    assert len(got) == 5 * 40 * 36
    for k, v in {**cases, 8: (0.0, 0.0), 9: (0.0, 0.0)}.items():
        inner = np.array([(r.vj, r.vi) for r in got if r.k == k and 8 <= r.j < 32 and 8 <= r.i < 28])
        assert np.abs(np.median(inner, axis=0) - v).max() < 0.35 and (k < 8 or not inner.any())


def test_one_scale_equals_numpy(spark):
    rng = np.random.default_rng(3)
    fields = [np.where(rng.random((9, 7)) < 0.2, np.nan, rng.gamma(1.0, 3.0, (9, 7))) for _ in range(3)]
    got = {(r.j, r.i): (r.vj, r.vi) for r in M.motion(spark.createDataFrame(rows_of(0, fields), FIELD), ["k"], "t", "v", 9, 7, coarse=1, scales=1, half=2).collect()}
    z = [np.where(np.nan_to_num(f) >= 0.1, 10 * np.log10(np.maximum(np.nan_to_num(f), 0.1)), -15.0) for f in fields]
    sums = np.zeros((5, 9, 7))
    for a, b in zip(z, z[1:]):
        gj, gi = np.gradient(a)
        for n, p in enumerate((gj * gj, gj * gi, gi * gi, gj * (b - a), gi * (b - a))):
            sums[n] += [[p[max(j - 2, 0) : j + 3, max(i - 2, 0) : i + 3].sum() for i in range(7)] for j in range(9)]
    r = 1e-2 * (sums[0] + sums[2]).mean() / 2
    for j in range(9):
        for i in range(7):
            jj, ji, ii, jd, id_ = sums[:, j, i]
            want = np.linalg.solve([[jj + r, ji], [ji, ii + r]], [-jd, -id_])
            assert got[j, i] == pytest.approx(tuple(want), abs=1e-9)
