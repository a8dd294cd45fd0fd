"""Gradient-boosted regression trees for a binary label, in numpy (used by the PII operator)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees of fixed depth as flat arrays: node i has children 2i+1 and 2i+2, leaves hold the step."""

    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    depth: int = 3

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            z += leaf[node - (1 << self.depth) + 1]
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Boosted:
    """Newton boosting on the logistic loss with exact splits."""
    model = Boosted(float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), [], depth)
    z = np.full(len(y), model.start)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 25), method="lower")) for j in range(x.shape[1])]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        feature, cut, leaf = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf), np.zeros(1 << depth)
        node = np.zeros(len(y), np.int64)
        for i in range((1 << depth) - 1):
            at = np.flatnonzero(node == i)
            best = 1e-9
            if len(at):
                gs, hs = g[at], h[at]
                whole = gs.sum() ** 2 / (hs.sum() + ridge)
                for j, values in enumerate(cuts):
                    for c in values:
                        right = x[at, j] > c
                        gr, hr = gs[right].sum(), hs[right].sum()
                        gain = gr * gr / (hr + ridge) + (gs.sum() - gr) ** 2 / (hs.sum() - hr + ridge) - whole
                        if gain > best:
                            best, feature[i], cut[i] = gain, j, c
                node[at] = 2 * i + 1 + (x[at, feature[i]] > cut[i])
        for k in range(1 << depth):
            at = node == (1 << depth) - 1 + k
            if at.any():
                leaf[k] = rate * g[at].sum() / (h[at].sum() + ridge)
        z += leaf[node - (1 << depth) + 1]
        model.trees.append((feature, cut, leaf))
    return model
