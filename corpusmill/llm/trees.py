"""Gradient-boosted trees and isotonic calibration, small enough to be broadcast."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting of trees of fixed depth on binned features; the same rows always give the same trees."""

    def __init__(self, n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 10, ridge: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least, self.ridge = n_trees, depth, rate, bins, least, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0
        self.known: tuple[np.ndarray, np.ndarray] | None = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        if len(y) == 0 or y.min() == y.max():
            self.base = 0.0 if len(y) == 0 else (20.0 if y[0] else -20.0)
            return self
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
        p0 = y.mean()
        self.base = float(np.log(p0 / (1 - p0)))
        margin = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature = np.full(2**self.depth - 1, -1)
            cut = np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                best = np.full(n, 1e-6)
                at = node - first
                for f in range(x.shape[1]):
                    if not len(edges[f]):
                        continue
                    key = at * (self.bins + 1) + binned[:, f]
                    size = n * (self.bins + 1)
                    g, h, c = (np.bincount(key, w, size).reshape(n, -1) for w in (grad, hess, None))
                    gl, hl, cl = g.cumsum(1), h.cumsum(1), c.cumsum(1)
                    gt, ht, ct = gl[:, -1:], hl[:, -1:], cl[:, -1:]
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(cl < self.least) | (ct - cl < self.least)] = 0
                    gain = gain[:, : len(edges[f])]
                    k = gain.argmax(1)
                    top = gain[np.arange(n), k]
                    for i in np.flatnonzero(top > best):
                        best[i], feature[first + i], cut[first + i] = top[i], f, edges[f][k[i]]
                node = self._down(x, node, feature, cut)
            leaf = node - (2**self.depth - 1)
            g, h = np.bincount(leaf, grad, 2**self.depth), np.bincount(leaf, hess, 2**self.depth)
            value = self.rate * g / (h + self.ridge)
            self.trees.append((feature, cut, value))
            margin += value[leaf]
        return self

    @staticmethod
    def _down(x, node, feature, cut):
        f = feature[node]
        v = x[np.arange(len(x)), np.maximum(f, 0)]
        return 2 * node + 1 + ((f >= 0) & (v > cut[node]))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = self._down(x, node, feature, cut)
            out += value[node - (2**self.depth - 1)]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Isotonic regression of the labels on the margin; both classes keep one pseudo-label each."""
        m = np.r_[self.margin(x), -30.0, 30.0]
        t = np.r_[y.astype(float), 0.0, 1.0]
        order = np.argsort(m, kind="stable")
        blocks: list[list[float]] = []
        for a, b in zip(m[order], t[order]):
            blocks.append([a, a, b, 1.0])
            while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
                lo, hi = blocks[-2], blocks.pop()
                w = lo[3] + hi[3]
                blocks[-1] = [lo[0], hi[1], (lo[2] * lo[3] + hi[2] * hi[3]) / w, w]
        self.known = (np.array([x for b in blocks for x in b[:2]]), np.array([b[2] for b in blocks for _ in (0, 1)]))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        return np.interp(m, *self.known) if self.known is not None else 1 / (1 + np.exp(-m))
