"""Boosted trees against a plain version that looks at the rows themselves, and what monotone features must do."""

import math

import numpy as np
import pytest

from tessera.operators import boosting as B
from tessera.operators import weighted as Q


def plain_tree(x, g, h, rows, depth, low, high, signs, how, edges):
    """{row: value} of one tree."""
    def value(own, low, high):
        return min(max(-sum(g[i] for i in own) / (sum(h[i] for i in own) + how.l2), low), high)

    def loss(own, v):
        return sum(g[i] for i in own) * v + 0.5 * (sum(h[i] for i in own) + how.l2) * v * v

    here = value(rows, low, high)
    best = (1e-12, None)
    for f in range(x.shape[1]) if depth else ():
        for e in edges[f]:
            a, b = [i for i in rows if x[i, f] <= e], [i for i in rows if x[i, f] > e]
            if min(len(a), len(b)) >= how.least:
                va, vb = value(a, low, high), value(b, low, high)
                gain = loss(rows, here) - loss(a, va) - loss(b, vb)
                if signs[f] * (vb - va) >= 0 and gain > best[0] + 1e-12:
                    best = (gain, (a, b, f, (va + vb) / 2))
    if best[1] is None:
        return dict.fromkeys(rows, here)
    a, b, f, mid = best[1]
    bounds = {1: ((low, min(high, mid)), (max(low, mid), high)), -1: ((max(low, mid), high), (low, min(high, mid))), 0: ((low, high), (low, high))}[signs[f]]
    return {k: v for own, (lo, hi) in zip((a, b), bounds) for k, v in plain_tree(x, g, h, own, depth - 1, lo, hi, signs, how, edges).items()}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    n = 150
    x = np.column_stack([rng.normal(size=n).round(2), rng.integers(0, 6, n), rng.normal(size=n)])
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.4 * x[:, 1])))).astype(int)
    fold = rng.integers(0, 3, n)
    df = spark.createDataFrame([(int(k), *map(float, x[k]), int(y[k]), int(fold[k])) for k in range(n)], "id long, a double, b double, c double, y int, f long").repartition(4)
    return df, x, y, fold


@pytest.mark.parametrize("signs", [(0, 0, 0), (1, -1, 0)])
def test_probabilities_equal_plain_trees(spark, table, signs):
    df, x, y, fold = table
    how = B.Boosting(rounds=5, rate=0.3, least=9, l2=1.0, bins=8, renew=2)
    got = {r.id: r.p for r in B.cross_validated(df, ["a", "b", "c"], "y", "f", signs, ["id"], how).collect()}
    edges = [np.unique(np.quantile(x[:, f], [k / how.bins for k in range(1, how.bins)])) for f in range(3)]
    for own in range(3):
        rest = [i for i in range(len(y)) if fold[i] != own]
        total = np.full(len(y), math.log(sum(y[rest]) / (len(rest) - sum(y[rest]))))
        for _ in range(how.rounds):
            p = 1 / (1 + np.exp(-total))
            g, h = p - y, p * (1 - p)
            tree = plain_tree(x, g, h, rest, how.depth, -math.inf, math.inf, signs, how, edges)
            # rows of the own fold follow the bins of a row that the tree was grown on
            bins = lambda i: tuple(int(np.searchsorted(edges[f], x[i, f], "left")) for f in range(3))  # noqa: E731, B023
            for i in rest:
                total[i] += how.rate * tree[i]
            leaf = {bins(i): tree[i] for i in rest}
            for i in range(len(y)):
                if fold[i] == own:
                    total[i] = total[i] + how.rate * leaf[bins(i)] if bins(i) in leaf else math.nan
        for i in range(len(y)):
            if fold[i] == own and not math.isnan(total[i]):
                assert got[i] == pytest.approx(1 / (1 + math.exp(-total[i])), abs=1e-9)
    assert len(got) == len(y)


def test_equal_rows_are_counted_and_dealt_by_their_number(spark, monkeypatch):
    df = spark.range(0, 4000, 1, 3).selectExpr("id", "double(id % 5) as v", "cast(id % 7 < id % 5 as int) as y", "id % 2 as f")
    kept = []
    monkeypatch.setattr(B, "durable", lambda d, f=B.durable: kept.append(f(d)) or kept[-1])
    how = B.Boosting(rounds=3, rate=0.3, bins=8, renew=1, task=6)
    got = {r.id: r.p for r in B.cross_validated(df, ["v"], "y", "f", [0], ["id"], how).collect()}
    assert len(got) == 4000 and max(k.count() for k in kept) == 18  # in 2 folds: 4 values of 2 outcomes, and one that never has the event
    assert kept[-1].rdd.getNumPartitions() == 3
    monkeypatch.undo()
    few = {r.v: r.p for r in B.cross_validated(df, ["v"], "y", "f", [0], ["v"], B.Boosting(rounds=3, rate=0.3, bins=8)).where("f = 0").collect()}
    assert len(few) == 5 and all(got[i] == pytest.approx(few[float(i % 5)]) for i in range(0, 4000, 2))


def test_monotone_features_never_lower_the_probability(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(v), int(rng.random() < 0.2 + 0.1 * v + 0.15 * math.sin(3 * v)), k % 2) for k, v in enumerate(rng.uniform(0, 6, 400))]
    df = spark.createDataFrame(rows, "id long, v double, y int, f int")
    got = B.cross_validated(df, ["v"], "y", "f", [1], ["id", "v"], B.Boosting(rounds=6, rate=0.5, bins=16)).collect()
    for f in (0, 1):
        p = [r.p for r in sorted(got, key=lambda r: r.v) if r.f == f]
        assert all(a <= b + 1e-12 for a, b in zip(p, p[1:])) and p[-1] > p[0]


def test_folds_without_events_and_odd_rows(spark):
    rows = [(1, 1.0, 0, "a"), (2, None, 0, "a"), (3, float("nan"), 1, "b"), (4, 2.0, 1, "b"), (5, 1.0, None, "a"), (6, 1.0, 1, None)]
    df = spark.createDataFrame(rows, "id long, v double, y int, f string")
    how = B.Boosting(rounds=2, least=1)
    assert {r.id: r.p for r in B.cross_validated(df, ["v"], "y", "f", keep=["id"], how=how).collect()} == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0}
    assert B.cross_validated(df.limit(0), ["v"], "y", "f", keep=["id"], how=how).collect() == []


def test_quantiles_of_a_whole_column(spark):
    rng = np.random.default_rng(2)
    v = [float(x) for x in rng.integers(0, 40, 301)] + [None]
    ps = [0.0, 0.013, 0.25, 0.5, 0.9, 0.999, 1.0]
    df = spark.createDataFrame([(x,) for x in v], "v double").repartition(5)
    assert Q.quantiles_of_all(df, "v", ps) == pytest.approx(list(np.quantile(v[:-1], ps)))
    assert all(math.isnan(q) for q in Q.quantiles_of_all(df.limit(0), "v", ps))
