"""Histogram gradient-boosted trees with logistic loss, flattened into arrays.

A tree of depth d is complete: node i has the children 2i + 1 (bin <= threshold) and 2i + 2. A node that is not worth a
split sends everything to the left. All trees together are three arrays, (trees, nodes) for feature and threshold and (trees, leaves)
for the value, so that a batch of rows goes down one level of one tree by three gathers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Forest:
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        rows = np.arange(len(bins))
        depth = int(np.log2(self.value.shape[1]))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(bins), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (bins[rows, feature[node]] > threshold[node])
            out += value[node - (len(value) - 1)]
        return out

    def probability(self, bins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(bins)))


def edges(values: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Inner bounds of at most ``bins`` equally filled bins for each column."""
    return [np.unique(np.quantile(c[np.isfinite(c)], np.linspace(0, 1, bins + 1)[1:-1])) if np.isfinite(c).any() else np.zeros(0) for c in values.T]


def binned(values: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    out = np.empty(values.shape, np.uint8)
    for k, b in enumerate(bounds):
        out[:, k] = np.searchsorted(b, values[:, k], "left")
    return out


def fit(bins: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None, trees: int = 80, depth: int = 4, rate: float = 0.15, ridge: float = 1.0, least: float = 5.0) -> Forest:
    """``bins`` are column values below ``BINS``; ``least`` is the smallest weight of a leaf. Without rows, or
    with one class only, the forest is a constant near that class."""
    n, columns = bins.shape
    weight = np.ones(n) if weight is None else weight.astype(float)
    total, good = weight.sum(), (weight * label).sum()
    base = float(np.log((good + 0.5) / (total - good + 0.5)))
    nodes, leaves = (1 << depth) - 1, 1 << depth
    forest = Forest(np.zeros((trees, nodes), np.int64), np.full((trees, nodes), 255, np.int64), np.zeros((trees, leaves)), base)
    if not n or good in (0, total):
        return forest
    margin = np.full(n, base)
    cell = bins.astype(np.int64) + np.arange(columns) * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = weight * (label - p), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            flat = ((node - first)[:, None] * (columns * BINS) + cell).ravel()
            shape = (width, columns, BINS)
            sums = [np.bincount(flat, np.repeat(x, columns), width * columns * BINS).reshape(shape).cumsum(2) for x in (slope, bend, weight)]
            (g, h, w), (G, H, W) = sums, [x[:, :1, -1:] for x in sums]
            gain = g**2 / (h + ridge) + (G - g) ** 2 / (H - h + ridge) - G**2 / (H + ridge)
            gain[(w < least) | (W - w < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            worth = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            forest.feature[t, first : first + width] = np.where(worth, best // BINS, 0)
            forest.threshold[t, first : first + width] = np.where(worth, best % BINS, 255)
            node = 2 * node + 1 + (bins[np.arange(n), forest.feature[t, node]] > forest.threshold[t, node])
        leaf = node - nodes
        top, low = np.bincount(leaf, slope, leaves), np.bincount(leaf, bend, leaves)
        forest.value[t] = rate * top / (low + ridge)
        margin += forest.value[t, leaf]
    return forest
