"""Gradient-boosted trees for a yes/no target, on a bounded sample in memory.

Features are cut into at most 32 bins; trees have a fixed depth and are stored as flat arrays, so
scoring a whole table of rows is a handful of array look-ups per tree.
"""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """Boosted trees: per tree the split feature and bin of each inner node, and the leaf values."""

    def __init__(self, depth: int = 4, rounds: int = 40, rate: float = 0.3, smooth: float = 1.0):
        self.depth, self.rounds, self.rate, self.smooth = depth, rounds, rate, smooth

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        steps = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, k], steps)) for k in range(x.shape[1])]
        # A value seen often needs its own edge above, or zero and more than zero share a bin.
        self.edges = [np.unique(np.concatenate([e, np.nextafter(e, np.inf)])) for e in self.edges]
        bins, wide = self._binned(x), 2 * BINS
        offset = np.arange(x.shape[1]) * wide
        base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(base / (1 - base)))
        total = np.full(len(y), self.base)
        self.features, self.cuts, self.leaves = [], [], []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-total))
            slope, curve = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            features, cuts = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, wide, np.int64)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                cell = ((node[:, None] - first) * x.shape[1] * wide + offset + bins).ravel()
                size = many * x.shape[1] * wide
                shape = (many, x.shape[1], wide)
                g = np.bincount(cell, np.repeat(slope, x.shape[1]), size).reshape(shape).cumsum(axis=2)
                h = np.bincount(cell, np.repeat(curve, x.shape[1]), size).reshape(shape).cumsum(axis=2)
                rest_g, rest_h = g[:, :, -1:] - g, h[:, :, -1:] - h
                gain = g**2 / (h + self.smooth) + rest_g**2 / (rest_h + self.smooth)
                gain[(h < 1) | (rest_h < 1)] = -1
                flat = gain.reshape(many, -1)
                found = flat.argmax(axis=1)
                whole = g[:, 0, -1] ** 2 / (h[:, 0, -1] + self.smooth)
                useful = flat[np.arange(many), found] > whole + 1e-6
                features[first : first + many] = np.where(useful, found // wide, 0)
                cuts[first : first + many] = np.where(useful, found % wide, wide)
                node = 2 * node + 1 + (bins[np.arange(len(y)), features[node]] > cuts[node])
            leaf = node - (2**self.depth - 1)
            value = np.bincount(leaf, slope, 2**self.depth) / (np.bincount(leaf, curve, 2**self.depth) + self.smooth)
            total += self.rate * value[leaf]
            self.features.append(features)
            self.cuts.append(cuts)
            self.leaves.append(self.rate * value)
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        bins, rows = self._binned(x), np.arange(len(x))
        total = np.full(len(x), self.base)
        for features, cuts, leaves in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (bins[rows, features[node]] > cuts[node])
            total += leaves[node - (2**self.depth - 1)]
        return total
