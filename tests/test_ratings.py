"""Rating curves against a walk along each profile."""

import math

import numpy as np
import pytest

from tessera.operators import ratings as T


def zone(s, z, level, a, b):
    area = bed = width = 0.0
    for k in range(a, b):
        d = [level - z[k], level - z[k + 1]]
        dx = s[k + 1] - s[k]
        if not all(map(math.isfinite, d)) or max(d) <= 0:
            continue
        part = 1.0 if min(d) > 0 else max(d) / abs(d[0] - d[1])
        area += dx * (sum(d) / 2 if min(d) > 0 else max(d) * part / 2)
        bed += math.hypot(dx, z[k + 1] - z[k]) if min(d) > 0 else math.hypot(part * dx, max(d))
        width += part * dx
    return area, bed, width


def walk(s, z, i, j, slope, flow):
    z = [math.inf if x is None else x for x in z]
    bed, out, top = min(z[i : j + 1]), [], 0.0
    n = math.ceil((min(z[i], z[j]) - bed + flow.above) / flow.step - 1e-9)
    for k in range(n + 1):
        level = bed + round(k * flow.step, 6)
        parts, unbounded = [(zone(s, z, level, i, j), flow.channel)], False
        for bank, step in ((i, -1), (j, 1)):
            if level > z[bank]:
                at = bank
                while 0 < at < len(z) - 1 and z[at + step] < level:
                    at += step
                end = at if at in (0, len(z) - 1) else at + step
                unbounded |= at in (0, len(z) - 1)
                parts.append((zone(s, z, level, min(bank, end), max(bank, end)), flow.plain))
        q = [a / r * (a / p) ** (2 / 3) * math.sqrt(slope) if a > 0 and p > 0 else 0.0 for (a, p, _), r in parts]
        (a, _, w) = parts[0][0]
        if flow.froude and w > 0:
            q[0] = min(q[0], flow.froude * a * math.sqrt(T.GRAVITY * a / w))
        top = max(top, sum(q))
        out.append((k, top, q[0], sum(p[0][0] for p in parts), sum(p[0][2] for p in parts), unbounded))
    return out


@pytest.mark.parametrize("flow", [T.Flow(step=0.25, above=3.0), T.Flow(step=0.5, froude=0.4)])
def test_curves_equal_a_walk(spark, flow):
    rng = np.random.default_rng(5)
    rows, sections, want = [], [], {}
    for k in range(6):
        s = [float(x) for x in np.cumsum(rng.uniform(0.5, 3, 24))]
        z = [float(abs(x - s[12]) / 6 + rng.uniform(0, 2)) for x in s]
        if k == 2:
            z[3] = None  # a wall on the left plain
        if k == 4:
            z[-1] = z[0] = 50.0
        i, j, slope = 8, 16, float(rng.uniform(1e-4, 1e-2))
        rows += [(k, a, b) for a, b in zip(s, z)]
        sections.append((k, s[i], s[j], slope))
        want[k] = walk(s, z, i, j, slope, flow)
    sections += [(20, 1.0, 0.0, 0.1), (21, 0.0, 1.0, 0.0)]
    rows += [(20, 0.0, 1.0), (20, 1.0, 1.0), (21, 0.0, 1.0), (21, 1.0, 1.0)]
    got = {}
    for r in T.rating_curves(spark.createDataFrame(rows, "section int, s double, z double"), spark.createDataFrame(sections, "section int, left double, right double, slope double"), flow).orderBy("section", "level").collect():
        got.setdefault(r.section, []).append((r.level, r.q, r.q_channel, r.area, r.width, r.open))
    assert set(got) == set(want)
    for k in want:
        assert [x[0] for x in got[k]] == [x[0] for x in want[k]] and [x[5] for x in got[k]] == [x[5] for x in want[k]]
        assert np.array([x[1:5] for x in got[k]]) == pytest.approx(np.array([x[1:5] for x in want[k]]), rel=1e-9, abs=1e-9)
