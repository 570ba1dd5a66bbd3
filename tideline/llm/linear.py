"""Linear classifiers that are fitted on the driver, on bounded samples or on sums over tasks."""

from __future__ import annotations

from collections.abc import Generator

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Sparse:
    """Rows of (column numbers, values), for products without a sparse library."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(rows)
        self.columns = np.concatenate([r[0] for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
        self.values = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0)
        self.row = np.repeat(np.arange(self.n), [len(r[0]) for r in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * w[self.columns], minlength=self.n)

    def back(self, e: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.columns, self.values * e[self.row], minlength=size)


def logistic(dot, back, size: int, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression by Adam on the whole sample. dot(w): margins; back(e): gradient of errors."""
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    weight = np.ones(len(y)) if weight is None else weight
    total = max(weight.sum(), 1e-9)
    for t in range(1, steps + 1):
        e = weight * (sigmoid(dot(w) + b) - y) / total
        g, gb = back(e) + l2 * w, e.sum()
        m, mb = 0.9 * m + 0.1 * g, 0.9 * mb + 0.1 * gb
        v, vb = 0.999 * v + 0.001 * g * g, 0.999 * vb + 0.001 * gb * gb
        c, d = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c) / (np.sqrt(v / d) + 1e-8)
        b -= rate * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    return w, float(b)


def descent(start: np.ndarray, most: int, memory: int = 8) -> Generator:
    """L-BFGS from `start` as a generator: it yields a point first, is sent the (loss, gradient) of the last point at most `most` times, and yields (next point, best point)."""
    w = start
    loss, g = yield w
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(most):
        d, kept = -g, []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            d = d - a * y
            kept.append(a)
        if pairs:
            s, y = pairs[-1]
            d = d * (s @ y) / (y @ y)
        else:
            d = d / max(np.linalg.norm(g), 1e-12)
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        step = 1.0
        while True:
            new = w + step * d
            new_loss, new_g = yield new, w
            if new_loss <= loss + 1e-4 * step * (g @ d) or step < 1e-6:
                break
            step /= 2
        if new_loss <= loss:
            if (new - w) @ (new_g - g) > 1e-12:
                pairs = [*pairs, (new - w, new_g - g)][-memory:]
            w, loss, g = new, new_loss, new_g
    while True:
        yield w, w


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) such that sigmoid(a * score + b) is the calibrated chance of y, by Newton's method with a small ridge."""
    spread = float(score.std()) or 1.0
    x = np.column_stack([score / spread, np.ones(len(score))])
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(2)
    for _ in range(50):
        p = sigmoid(x @ w)
        g = x.T @ (p - target) + 1e-3 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w -= np.clip(np.linalg.solve(h, g), -2, 2)
    return float(w[0] / spread), float(w[1])
