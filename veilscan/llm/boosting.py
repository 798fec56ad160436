"""Gradient-boosted trees for two classes: logistic loss, second-order gains, histograms."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Complete binary trees of one depth, so that a whole batch walks down together."""

    def __init__(self, trees: int = 50, depth: int = 4, rate: float = 0.2, bins: int = 24, ridge: float = 2.0, least: float = 4.0, columns: float = 1.0):
        """``columns``: the share of the features that each tree may use, drawn from a fixed seed."""
        self.columns = columns
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        n, width = x.shape
        weight = np.ones(n) if weight is None else weight
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        most, inner = self.bins + 1, (1 << self.depth) - 1
        self.feature = np.zeros((self.trees, inner), np.int32)
        self.cut = np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, 1 << self.depth))
        self.base = float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
        total = np.full(n, self.base)
        rng = np.random.default_rng(0)
        for t in range(self.trees):
            used = [f for f in range(width) if len(edges[f]) and (self.columns == 1 or rng.random() < self.columns)]
            p = 1 / (1 + np.exp(-total))
            g, h = weight * (y - p), weight * p * (1 - p)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                nodes, first = 1 << level, (1 << level) - 1
                best, which, where = np.full(nodes, 1e-6), np.zeros(nodes, np.int64), np.full(nodes, -1)
                sum_g, sum_h = np.bincount(at, g, nodes), np.bincount(at, h, nodes)
                whole = sum_g**2 / (sum_h + self.ridge)
                for f in used:
                    cell = at * most + binned[:, f]
                    left_g, left_h = (np.bincount(cell, v, nodes * most).reshape(nodes, most).cumsum(1) for v in (g, h))
                    right_g, right_h = sum_g[:, None] - left_g, sum_h[:, None] - left_h
                    gain = left_g**2 / (left_h + self.ridge) + right_g**2 / (right_h + self.ridge) - whole[:, None]
                    gain[(left_h < self.least) | (right_h < self.least)] = -1
                    gain[:, len(edges[f]) :] = -1
                    top = gain.argmax(1)
                    better = gain[np.arange(nodes), top] > best
                    best[better], which[better], where[better] = gain[better, top[better]], f, top[better]
                for node in np.flatnonzero(where >= 0):
                    self.feature[t, first + node], self.cut[t, first + node] = which[node], edges[which[node]][where[node]]
                at = 2 * at + (x[np.arange(n), self.feature[t, first + at]] > self.cut[t, first + at])
            leaves = 1 << self.depth
            self.leaf[t] = self.rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + self.ridge)
            total += self.leaf[t][at]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.trees):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.cut[t, at])
            out += self.leaf[t, at - ((1 << self.depth) - 1)]
        return out
