"""Fitting the censored shifted gamma law to forecasts and what came of them, by the least continuous ranked probability
score. All trial points of a round are scored in one pass over the rows; a trial's sums are all that comes to the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.special import log_gamma, lower_gamma, normal_quantile
from tessera.operators.search import Search
from tessera.sources.storage import durable


@dataclass(frozen=True)
class Law:
    """mean = a0 + a1 m + a2 q and deviation = b0 sqrt(mean) + b1 (q - m) of a gamma law, moved by shift (not above 0) and
    censored at 0; m is the forecast's mean, q its upper quantile."""

    a0: float
    a1: float
    a2: float
    b0: float
    b1: float
    shift: float

    @classmethod
    def of(cls, free: np.ndarray) -> Law:
        """From six free numbers: all parameters keep their signs."""
        a0, a1, a2, b0, b1, s = (float(x) for x in np.logaddexp(0.0, free))
        return cls(a0 + 1e-3, a1, a2, b0 + 1e-3, b1, -s)

    def shape_scale(self, m: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = np.maximum(m, 0.0)
        q = np.maximum(q, m)
        mean = self.a0 + self.a1 * m + self.a2 * q
        deviation = np.maximum(self.b0 * np.sqrt(mean) + self.b1 * (q - m), 1e-3)
        return (mean / deviation) ** 2, deviation**2 / mean


#: Where the search starts: parameters before they are freed. Fixed values.
STARTS = ((0.3, 0.7, 0.2, 0.8, 0.5, 0.5), (0.1, 1.0, 0.05, 1.5, 0.2, 0.1), (1.0, 0.4, 0.5, 0.5, 1.0, 1.5))

#: Rows that a task scores in a round.
TASK_ROWS = 25_000


def freed(x: Sequence[float]) -> np.ndarray:
    return np.log(np.expm1(np.maximum(np.array(x, float), 1e-6)))


def crps(y: np.ndarray, shape: np.ndarray, scale: np.ndarray, shift: float) -> np.ndarray:
    """Of the censored shifted gamma law, in closed form: distribution functions of the law, of the next greater shape, and of twice
    the shape, at the outcome and at the censoring point."""
    z, c = np.maximum((y - shift) / scale, 0.0), np.broadcast_to(-shift / scale, y.shape)
    at = lower_gamma(np.stack([shape, shape, 2 * shape]), np.stack([z, c, 2 * c]))
    density = lambda x: np.where(x > 0, np.exp(shape * np.log(np.maximum(x, 1e-300)) - x - log_gamma(shape + 1)), 0.0)
    below, dry = at[0], at[1]
    below1, dry1 = below - density(z), dry - density(c)  # of shape + 1
    half = np.exp(0.5 * math.log(math.pi) + log_gamma(shape + 0.5) - log_gamma(shape + 1)) / math.pi
    return scale * (z * (2 * below - 1) - c * dry**2 + shape * (1 + 2 * dry * dry1 - dry**2 - 2 * below1) - shape * half * (1 - at[2]))


def trial_scores(rows: DataFrame, trials: list[np.ndarray]) -> np.ndarray:
    """Weighted mean score of each trial. rows: m, q, y, w."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(len(trials)), 0.0
        for b in batches:
            m, q, y, w = (c.to_numpy() for c in b.columns)
            weight += float(w.sum())
            for k, free in enumerate(trials):
                law = Law.of(free)
                total[k] += float((w * crps(y, *law.shape_scale(m, q), law.shift)).sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(trials)), pa.int32()), pa.array(total), pa.array([weight] * len(trials))], ["k", "total", "weight"])

    got = rows.mapInArrow(score, "k int, total double, weight double").groupBy("k").agg((F.sum("total") / F.sum("weight")).alias("score")).collect()
    out = np.full(len(trials), np.inf)
    for r in got:
        if r["score"] is not None and math.isfinite(r["score"]):
            out[r["k"]] = r["score"]
    return out


def fit(df: DataFrame, mean: str, upper: str, outcome: str, weight: str | None = None, rounds: int = 40, sample: int = 16, seed: int = 1) -> tuple[Law, float, float] | None:
    """(law, its mean score, the mean absolute error of the forecast's mean), or None without rows.

    A search by samples that adapt their covariance: each round draws `sample` trials around a centre, scores all of them in
    one pass, moves to the mean of the better half and learns the shape of good steps. It starts from the best of STARTS.
    Rows with a null or non-finite number, or without weight, take no part; an upper quantile below the mean counts as the mean."""
    fine = lambda c: F.col(c).cast("double").isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf"))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(fine(mean) & fine(upper) & fine(outcome)).select(F.col(mean).cast("double").alias("m"), F.greatest(upper, mean).cast("double").alias("q"), F.col(outcome).cast("double").alias("y"), w.alias("w")).where("w > 0")
    rows = durable(rows)
    n, raw = rows.agg(F.count("*"), F.sum(F.col("w") * F.abs(F.col("m") - F.col("y"))) / F.sum("w")).first()
    if raw is None:
        return None
    rows = durable(rows.repartition(-(-n // TASK_ROWS)))  # few bytes, but much work: not as many tasks as the bytes ask for
    starts = [freed(s) for s in STARTS]
    first = trial_scores(rows, starts)
    search = Search(starts[int(first.argmin())], float(first.min()), sample, np.random.default_rng(seed), 20.0)
    for _ in range(rounds):
        search.learn(trial_scores(rows, list(search.trials())))
        if search.done:
            break
    return Law.of(search.best[1]), search.best[0], float(raw)


def outcome_scores(law: Law, m: np.ndarray, q: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Probability of at most the outcome; half of the mass at 0 if it is dry."""
    shape, scale = law.shape_scale(m, q)
    dry = lower_gamma(shape, -law.shift / scale)
    return np.where(y <= 0, dry / 2, lower_gamma(shape, np.maximum((y - law.shift) / scale, 0.0)))


def copula_correlation(df: DataFrame, first: tuple[Law, str, str, str], second: tuple[Law, str, str, str], least: int = 50, usual: float = 0.7) -> float:
    """Correlation of the normal scores of two outcomes given their forecasts, over rows where at least one is wet; the usual value
    with fewer than `least` of these. first, second: law, and the columns of mean, upper quantile and outcome."""
    columns = [*first[1:], *second[1:]]
    rows = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).dropna().where("c2 > 0 or c5 > 0")

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [c.to_numpy() for c in b.columns]
            z = [normal_quantile(np.clip(outcome_scores(law, *x[k : k + 3]), 1e-4, 1 - 1e-4)) for law, k in ((first[0], 0), (second[0], 3))]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in z], ["a", "b"])

    got = rows.mapInArrow(normal, "a double, b double").agg(F.count("*").alias("n"), F.corr("a", "b").alias("r")).first()
    return usual if got["n"] < least or got["r"] is None or math.isnan(got["r"]) else float(got["r"])
