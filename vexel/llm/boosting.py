"""Gradient-boosted regression trees for a binary label, on bounded numpy tables."""

from __future__ import annotations

import numpy as np

from .linear import sigmoid


class Trees:
    """Trees of a fixed depth over integer features; a node asks whether feature > threshold."""

    def __init__(self, depth: int = 4, rate: float = 0.3, l2: float = 1.0):
        self.depth, self.rate, self.l2 = depth, rate, l2
        self.features: list[np.ndarray] = []
        self.thresholds: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = 60, bins: int = 64) -> Trees:
        """x: integers from 0 to bins - 1."""
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        n_features = x.shape[1]
        flat = x.astype(np.int64) + np.arange(n_features) * bins
        for _ in range(trees):
            p = sigmoid(margin)
            g, h = p - y, p * (1 - p) + 1e-6
            node = np.zeros(len(y), np.int64)  # within its level
            features, thresholds = [], []
            for level in range(self.depth):
                width = 1 << level
                at = (node[:, None] * (n_features * bins) + flat).ravel()
                size = width * n_features * bins
                sums = [np.bincount(at, weights=np.repeat(v, n_features), minlength=size).reshape(width, n_features, bins).cumsum(2) for v in (g, h)]
                (gl, hl), (ga, ha) = sums, [s[:, :, -1:] for s in sums]
                gain = gl**2 / (hl + self.l2) + (ga - gl) ** 2 / (ha - hl + self.l2) - ga**2 / (ha + self.l2)
                best = gain.reshape(width, -1).argmax(1)
                f, t = best // bins, best % bins
                features.append(f)
                thresholds.append(t)
                node = 2 * node + (x[np.arange(len(y)), f[node]] > t[node])
            leaves = -self.rate * np.bincount(node, weights=g, minlength=1 << self.depth) / (np.bincount(node, weights=h, minlength=1 << self.depth) + self.l2)
            margin += leaves[node]
            self.features.append(np.concatenate(features))
            self.thresholds.append(np.concatenate(thresholds))
            self.leaves.append(leaves)
        return self

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaves in zip(self.features, self.thresholds, self.leaves):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = node + (1 << level) - 1
                node = 2 * node + (x[rows, f[at]] > t[at])
            out += leaves[node]
        return out
