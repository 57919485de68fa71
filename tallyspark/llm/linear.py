"""Small linear models, fitted in memory on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Logistic:
    """Logistic regression on standardised features with an L2 penalty, by Newton steps.

    With no rows or one class only it answers the smoothed share of the class for every row.
    """

    def __init__(self, penalty: float = 1.0, steps: int = 25):
        self.penalty, self.steps = penalty, steps

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        weight = np.ones(len(y)) if weight is None else weight
        share = (float(weight @ y) + 1) / (float(weight.sum()) + 2) if len(y) else 0.5
        self.mean = x.mean(axis=0) if len(y) else np.zeros(x.shape[1])
        spread = x.std(axis=0) if len(y) else np.ones(x.shape[1])
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        self.w = np.zeros(x.shape[1] + 1)
        self.w[-1] = float(logit(np.array(share)))
        if len(np.unique(y)) < 2:
            return self
        design = self._design(x)
        ridge = np.full(design.shape[1], self.penalty)
        ridge[-1] = 1e-9
        for _ in range(self.steps):
            p = sigmoid(design @ self.w)
            gradient = design.T @ (weight * (p - y)) + ridge * self.w
            curve = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + np.diag(ridge)
            step = np.linalg.solve(curve, gradient)
            length = np.abs(step).max()
            self.w -= step * min(1.0, 5.0 / length) if length else step
            if length < 1e-6:
                break
        return self

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -10, 10), np.ones((len(x), 1))])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self._design(x) @ self.w)


def folds_of(keys: np.ndarray, folds: int) -> np.ndarray:
    """A fold per integer key, the same wherever the key stands."""
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(40)).astype(np.int64) % folds
