"""Gradient-boosted trees for a binary label, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: a split's feature and threshold, and the leaves' values."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss over quantile bins; a split needs `least` of the Hessian on both sides."""
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base, inner = float(np.log(p / (1 - p))), (1 << depth) - 1
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)  # code <= i: x <= edge i
    z = np.full(len(y), base)
    out = Trees(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    for t in range(trees):
        q = 1 / (1 + np.exp(-z))
        g, h = q - y, q * (1 - q)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            node = at - first
            best = np.full(n, 1e-9)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key = node * (bins + 1) + codes[:, f]
                sums = [np.bincount(key, v, n * (bins + 1)).reshape(n, -1) for v in (g, h)]
                (gl, hl), (ga, ha) = [s.cumsum(1)[:, : len(e)] for s in sums], [s.sum(1, keepdims=True) for s in sums]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < least) | (ha - hl < least)] = 0
                top = gain.argmax(1)
                won = np.flatnonzero(gain[np.arange(n), top] > best)
                best[won] = gain[won, top[won]]
                out.feature[t, first + won], out.threshold[t, first + won] = f, e[top[won]]
            at = 2 * at + 1 + (x[np.arange(len(y)), out.feature[t, at]] > out.threshold[t, at])
        leaf = at - inner
        out.leaf[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        z += out.leaf[t, leaf]
    return out
