"""Logistic regression on a bounded sample, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Rows:
    """Sparse rows: column numbers row after row, where each row starts, and a factor for each column."""

    at: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    scale: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray], columns: int, scale: np.ndarray | None = None) -> Rows:
        lengths = np.array([len(x) for x in rows], np.int64)
        at = np.concatenate([*rows, np.zeros(0, np.int64)])
        return cls(at, np.cumsum(lengths) - lengths, lengths, np.ones(columns) if scale is None else scale)

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum((w * self.scale)[self.at])))
        return sums[self.starts + self.lengths] - sums[self.starts]

    def transposed_dot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, np.repeat(g, self.lengths), len(self.scale)) * self.scale


def fit_logistic(rows: Rows, y: np.ndarray, l2: float, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the mean log loss plus l2/2 times the weights' squares.

    Accelerated gradient steps of a length that the data bound (power iteration), restarted when the
    loss rises.
    """
    n = len(y)
    v = np.ones(len(rows.scale)) / np.sqrt(len(rows.scale))
    bound = 1.0
    for _ in range(15):
        u = rows.transposed_dot(rows.dot(v))
        bound = float(np.linalg.norm(u)) or 1.0
        v = u / bound
    step = 1 / (0.25 * (bound / n + 1) + l2)
    w, b = np.zeros(len(rows.scale)), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    w0, b0, k, last = w, b, 1, np.inf
    for _ in range(steps):
        momentum = (k - 1) / (k + 2)
        wm, bm = w + momentum * (w - w0), b + momentum * (b - b0)
        p = sigmoid(rows.dot(wm) + bm)
        loss = -np.mean(np.log(np.where(y > 0, p, 1 - p) + 1e-15)) + l2 / 2 * float(wm @ wm)
        g = (p - y) / n
        w0, b0 = w, b
        w, b = wm - step * (rows.transposed_dot(g) + l2 * wm), bm - step * float(g.sum())
        k = 1 if loss > last else k + 1
        last = loss
    return w, b
