"""A search without derivatives: draws whose covariance adapts to the steps that were good."""

from __future__ import annotations

import math

import numpy as np

#: Turns without a better trial after which a search is settled, though it has not narrowed.
STILL = 60


class Search:
    """Each round `trials` gives draws around a centre; `learn` takes their scores, moves the centre to the weighted mean of the
    better half and learns the shape of good steps. `best` is the best trial so far and its score."""

    def __init__(self, start: np.ndarray, score: float, sample: int, rng: np.random.Generator, bound: float, size: float = 0.5):
        n = len(start)
        self.best = (score, start)
        self.rng, self.bound, self.sample = rng, bound, sample
        share = np.log(sample // 2 + 0.5) - np.log(np.arange(1, sample // 2 + 1))
        self.share = share / share.sum()
        self.mass = 1 / (self.share**2).sum()
        self.c_path, self.c_step = (4 + self.mass / n) / (n + 4 + 2 * self.mass / n), (self.mass + 2) / (n + self.mass + 5)
        self.damp = 1 + self.c_step + 2 * max(0.0, math.sqrt((self.mass - 1) / (n + 1)) - 1)
        self.c_one = 2 / ((n + 1.3) ** 2 + self.mass)
        self.c_many = min(1 - self.c_one, 2 * (self.mass - 2 + 1 / self.mass) / ((n + 2) ** 2 + self.mass))
        self.usual = math.sqrt(n) * (1 - 1 / (4 * n) + 1 / (21 * n * n))  # length of a standard normal vector
        self.centre, self.size, self.turn, self.gained = start, size, 0, 0
        self.spread, self.path, self.step_path = np.eye(n), np.zeros(n), np.zeros(n)
        self._factor()

    def _factor(self) -> None:
        self.values, self.vectors = np.linalg.eigh(self.spread)

    @property
    def done(self) -> bool:
        return self.turn > 0 and self.size * math.sqrt(float(self.before.max())) < 1e-4

    @property
    def settled(self) -> bool:
        """Steps need not narrow where the goal is flat: there it is enough that nothing better has been found for long."""
        return self.done or self.turn - self.gained >= STILL

    def trials(self) -> np.ndarray:
        root = self.vectors * np.sqrt(np.maximum(self.values, 1e-20))
        self.draws = self.rng.normal(size=(self.sample, len(self.centre))) @ root.T
        self.points = np.clip(self.centre + self.size * self.draws, -self.bound, self.bound)
        return self.points

    def learn(self, scores: np.ndarray) -> None:
        self.turn += 1
        order = np.argsort(scores, kind="stable")[: len(self.share)]
        if scores[order[0]] < self.best[0] - 1e-9 * max(1.0, abs(scores[order[0]])):
            self.gained = self.turn
        if scores[order[0]] < self.best[0]:
            self.best = (float(scores[order[0]]), self.points[order[0]])
        n = len(self.centre)
        moved = self.share @ self.draws[order]
        self.centre = np.clip(self.centre + self.size * moved, -self.bound, self.bound)
        white = self.vectors @ ((self.vectors.T @ moved) / np.sqrt(np.maximum(self.values, 1e-20)))
        self.step_path = (1 - self.c_step) * self.step_path + math.sqrt(self.c_step * (2 - self.c_step) * self.mass) * white
        length = float(np.linalg.norm(self.step_path))
        steady = length / math.sqrt(1 - (1 - self.c_step) ** (2 * self.turn)) < (1.4 + 2 / (n + 1)) * self.usual
        self.path = (1 - self.c_path) * self.path + steady * math.sqrt(self.c_path * (2 - self.c_path) * self.mass) * moved
        self.spread = (1 - self.c_one - self.c_many) * self.spread + self.c_one * np.outer(self.path, self.path) + self.c_many * (self.draws[order].T * self.share) @ self.draws[order]
        self.size *= math.exp(self.c_step / self.damp * (length / self.usual - 1))
        self.before = self.values
        self._factor()
