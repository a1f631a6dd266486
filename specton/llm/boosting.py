"""Gradient-boosted regression trees for a binary target, on histograms of binned features, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss; trees of a fixed depth kept as arrays, so that all rows of a batch are scored at once."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, l2: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        n, d = x.shape
        w = np.ones(n) if weight is None else weight
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        b = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)
        p = np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        inner = 2**self.depth - 1
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.cut = np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, inner + 1))
        f = np.full(n, self.start)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = w * (y - p), w * p * (1 - p)
            at = np.zeros(n, np.int64)  # place of the row's node within its level
            for level in range(self.depth):
                best_gain, best = np.full(2**level, 1e-6), [(0, np.inf, self.bins)] * 2**level
                for j in range(d):
                    key = at * self.bins + b[:, j]
                    gs = np.bincount(key, g, 2**level * self.bins).reshape(-1, self.bins).cumsum(1)
                    hs = np.bincount(key, h, 2**level * self.bins).reshape(-1, self.bins).cumsum(1)
                    ga, ha = gs[:, -1:], hs[:, -1:]
                    score = lambda a, c: a * a / (c + self.l2)
                    gain = score(gs, hs) + score(ga - gs, ha - hs) - score(ga, ha)
                    k = gain[:, : len(self.edges[j])].argmax(1) if len(self.edges[j]) else None
                    for node in range(2**level) if k is not None else ():
                        if gain[node, k[node]] > best_gain[node]:
                            best_gain[node], best[node] = gain[node, k[node]], (j, self.edges[j][k[node]], k[node])
                first = 2**level - 1
                right = np.zeros(n, bool)
                for node, (j, cut, k) in enumerate(best):
                    self.feature[t, first + node], self.cut[t, first + node] = j, cut
                    own = at == node
                    right[own] = b[own, j] > k
                at = 2 * at + right
            gs, hs = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
            self.leaf[t] = self.rate * gs / (hs + self.l2)
            f += self.leaf[t][at]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for t in range(self.trees):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2**level - 1 + at
                at = 2 * at + (x[rows, self.feature[t][node]] >= self.cut[t][node])
            out += self.leaf[t][at]
        return out
