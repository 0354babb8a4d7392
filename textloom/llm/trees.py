"""Boosted trees on binned features, and isotonic regression, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Binary log-loss boosting of depth-limited trees; equal inputs give equal models."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, l2: float = 3.0, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least
        self.cuts: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]) if len(self.cuts) else np.zeros((len(x), 0), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4))
        self.base = float(np.log(p / (1 - p)))
        if len(np.unique(y)) < 2:
            return self
        self.cuts = [np.unique(np.quantile(c[c != 0] if (c != 0).sum() > 20 else c, np.linspace(0, 1, self.bins)[1:-1])) for c in x.T]
        self.cuts = [np.unique(np.concatenate([[1e-12], c])) for c in self.cuts]
        b, f = self._binned(x), np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            tree, leaf = self._grow(b, q - y, q * (1 - q))
            self.trees.append(tree)
            f += self.rate * leaf
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[tuple, np.ndarray]:
        """Trees are complete: node i has children 2i+1 and 2i+2; a node without split sends all left."""
        inner, width = 2**self.depth - 1, self.bins + 1
        feature, cut, value = np.zeros(inner, int), np.full(inner, width), np.zeros(inner + 2**self.depth)
        node = np.zeros(len(g), int)
        for level in range(self.depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            total_g, total_h = np.bincount(local, g, count), np.bincount(local, h, count)
            best = np.full(count, 1e-6)
            for j in range(b.shape[1]):
                at = local * width + b[:, j]
                gl = np.bincount(at, g, count * width).reshape(count, width).cumsum(1)
                hl = np.bincount(at, h, count * width).reshape(count, width).cumsum(1)
                gr, hr = total_g[:, None] - gl, total_h[:, None] - hl
                gain = gl**2 / (hl + self.l2) + gr**2 / (hr + self.l2) - (total_g**2 / (total_h + self.l2))[:, None]
                gain[(hl < self.least) | (hr < self.least)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(count), k]
                for i in np.flatnonzero(top > best + 1e-9):
                    best[i], feature[first + i], cut[first + i] = top[i], j, k[i]
            right = b[np.arange(len(g)), feature[node]] > cut[node]
            node = 2 * node + 1 + right
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
        value[inner:] = -gs / (hs + self.l2)
        return (feature, cut, value), value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds before calibration."""
        f, b = np.full(len(x), self.base), self._binned(x)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            f += self.rate * value[node]
        return f


class Isotonic:
    """Non-decreasing fit by pooling adjacent violators, linear between pool centres."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        pools: list[list[float]] = []  # sum of y, weight, sum of x
        for xi, yi in zip(x[order], y[order], strict=True):
            pools.append([yi, 1.0, xi])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.x = np.array([p[2] / p[1] for p in pools] or [0.0])
        mean = float(y.mean()) if len(y) else 0.5
        # one pseudo-row at the base rate keeps pure pools off 0 and 1
        self.y = np.maximum.accumulate(np.array([(p[0] + mean) / (p[1] + 1) for p in pools] or [mean]))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(x, self.x, self.y), 0.0, 1.0)
