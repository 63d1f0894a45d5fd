"""Gradient-boosted trees for two classes, on binned features; small enough to fit on a bounded sample and to ship to tasks."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """rounds trees of a fixed depth with logistic loss. Features are cut at quantiles into at most `bins` bins."""

    rounds: int = 40
    depth: int = 4
    rate: float = 0.25
    bins: int = 32
    smooth: float = 1.0
    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        self.edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, self.bins + 1)[1:-1])) for i in range(width)]
        b = self.binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start, self.trees = float(np.log(share / (1 - share))), []
        value, flat = np.full(n, self.start), b + np.arange(width) * self.bins
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-value))
            g, h = y - p, p * (1 - p)
            inner, leaves = (1 << self.depth) - 1, 1 << self.depth
            feature, cut, at = np.zeros(inner, np.int64), np.full(inner, self.bins, np.int64), np.zeros(n, np.int64)
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                cells = ((at - first)[:, None] * width * self.bins + flat).ravel()
                size = count * width * self.bins
                sums = [np.bincount(cells, np.repeat(v, width), size).reshape(count, width, self.bins) for v in (g, h)]
                left_g, left_h = np.cumsum(sums[0], axis=2), np.cumsum(sums[1], axis=2)
                all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
                gain = left_g**2 / (left_h + self.smooth) + (all_g - left_g) ** 2 / (all_h - left_h + self.smooth) - all_g**2 / (all_h + self.smooth)
                gain[(left_h < 1) | (all_h - left_h < 1)] = 0
                best = gain.reshape(count, -1).argmax(axis=1)
                good = gain.reshape(count, -1).max(axis=1) > 1e-6
                feature[first : first + count] = best // self.bins
                cut[first : first + count] = np.where(good, best % self.bins, self.bins)
                at = 2 * at + 1 + (b[np.arange(n), feature[at]] > cut[at])
            leaf = at - inner
            weight = self.rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + self.smooth)
            self.trees.append((feature, cut, weight))
            value += weight[leaf]
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        b, rows, inner = self.binned(x), np.arange(len(x)), (1 << self.depth) - 1
        value = np.full(len(x), self.start)
        for feature, cut, weight in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            value += weight[at - inner]
        return value
