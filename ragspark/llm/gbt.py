"""Gradient-boosted trees for a bounded sample, in NumPy: logistic loss, binned columns, level by level."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ragspark.llm.linear import sigmoid

BINS = 32


@dataclass
class Trees:
    """Complete trees of one depth: a column and threshold for each inner node, a value for each leaf."""

    columns: np.ndarray  # trees x inner nodes
    thresholds: np.ndarray
    leaves: np.ndarray  # trees x leaves
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.bias), np.arange(len(x))
        depth = self.leaves.shape[1].bit_length() - 1
        for column, threshold, leaf in zip(self.columns, self.thresholds, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, column[at]] > threshold[at])
            total += leaf[at - (len(leaf) - 1)]
        return sigmoid(total)


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 1.0, weight: np.ndarray | float = 1.0) -> Trees:
    """Trees for P(y = 1), rows counting by weight. Each split has the best gain over the columns' quantile bins."""
    n, m = x.shape
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)  # value > edge b-1
    ones, zeros = (y * weight).sum(), ((1 - y) * weight).sum()
    bias = float(np.log((ones + 1) / (zeros + 1)))
    score, out = np.full(n, bias), ([], [], [])
    flat = binned + np.arange(m) * BINS
    for _ in range(trees):
        p = sigmoid(score)
        g, h = (y - p) * weight, p * (1 - p) * weight
        column, threshold, at = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            place = ((at - first)[:, None] * (m * BINS) + flat).ravel()
            sums = [np.bincount(place, np.repeat(v, m), width * m * BINS).reshape(width, m, BINS).cumsum(axis=2) for v in (g, h)]
            (gl, hl), (gt, ht) = sums, (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < 1e-2) | (ht - hl < 1e-2)] = 0
            for k in range(width):
                c, b = np.unravel_index(np.argmax(gain[k]), gain[k].shape)
                if gain[k, c, b] > 1e-6 and b < len(edges[c]):
                    column[first + k], threshold[first + k] = c, edges[c][b]
            at = 2 * at + 1 + (x[np.arange(n), column[at]] > threshold[at])
        at -= 2**depth - 1
        leaf = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + l2)
        score += leaf[at]
        for kept, new in zip(out, (column, threshold, leaf)):
            kept.append(new)
    return Trees(*(np.array(v) for v in out), bias)
