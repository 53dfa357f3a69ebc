"""Gradient-boosted decision trees on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

TREES, DEPTH, BINS = 60, 4, 24
SHRINK, RIDGE, LEAST = 0.2, 1.0, 8


@dataclass
class Forest:
    """Trees of equal depth: the feature and the bin of each inner node, the value of each leaf."""

    edges: list[np.ndarray]
    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    border: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)]).astype(np.int16)

    def logit(self, x: np.ndarray) -> np.ndarray:
        binned = self.bins(x)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, b, v in zip(self.feature, self.border, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (binned[rows, f[at]] > b[at])
            out += v[at - (1 << DEPTH) + 1]
        return out


def _histograms(columns: list[np.ndarray], flags: np.ndarray, rows: np.ndarray | slice, node: np.ndarray, weights: np.ndarray, count: int) -> np.ndarray:
    """Sums of the weights (3, rows) by node, feature and bin: (3, nodes, features, BINS + 1). columns: bins of the features
    with more than two; flags: those with two, as 0 and 1, which come last."""
    out = np.zeros((len(weights), count, len(columns) + flags.shape[1], BINS + 1))
    base = node * (BINS + 1)
    for j, column in enumerate(columns):
        key = base + column[rows]
        for k, w in enumerate(weights):
            out[k, :, j] = np.bincount(key, weights=w, minlength=count * (BINS + 1)).reshape(count, -1)
    by_node = np.zeros((len(node), count * len(weights)), np.float64)
    at = np.arange(len(node))
    for k, w in enumerate(weights):
        by_node[at, node * len(weights) + k] = w
    high = (flags[rows].T @ by_node).reshape(flags.shape[1], count, len(weights)).transpose(2, 1, 0)
    whole = by_node.sum(axis=0).reshape(count, len(weights)).T[:, :, None]
    out[:, :, len(columns) :, 1] = high
    out[:, :, len(columns) :, 0] = whole - high
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Logistic loss, second-order gains, trees grown level by level on histograms; of two children only the smaller one is
    counted, the other is what is left of the parent."""
    edges = []
    for j in range(x.shape[1]):
        e = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]))
        edges.append(e)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    forest = Forest(edges, float(np.log(share / (1 - share))))
    binned = forest.bins(x)
    n, width = binned.shape
    two = [j for j in range(width) if len(edges[j]) <= 1]
    many = [j for j in range(width) if len(edges[j]) > 1]
    columns, flags = [binned[:, j].astype(np.int64) for j in many], binned[:, two].astype(np.float64)
    feature_of = np.array(many + two)
    logit = np.full(n, forest.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        weights = np.stack([p - y, p * (1 - p), np.ones(n)])
        inner = (1 << DEPTH) - 1
        feature, border = np.zeros(inner, np.int64), np.full(inner, BINS + 1, np.int64)
        at = np.zeros(n, np.int64)
        counts = np.zeros(0)
        for level in range(DEPTH):
            first, count = (1 << level) - 1, 1 << level
            node = at - first
            if level == 0:
                counts = _histograms(columns, flags, slice(None), node, weights, 1)
            else:
                size = np.bincount(node, minlength=count)
                small = np.where(size[1::2] < size[::2], 1, 0) + 2 * np.arange(count // 2)
                rows = np.flatnonzero(np.isin(node, small))
                own = _histograms(columns, flags, rows, node[rows] // 2, weights[:, rows], count // 2)
                both = np.empty((len(weights), count, *counts.shape[2:]))
                both[:, small], both[:, small ^ 1] = own, counts - own
                counts = both
            total = counts[:, :, 0].sum(axis=2)
            left = np.cumsum(counts, axis=3)
            (left_g, left_h, left_n), (total_g, total_h, total_n) = left, total[:, :, None, None]
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - total_g**2 / (total_h + RIDGE)
            gain[(left_n < LEAST - 0.5) | (total_n - left_n < LEAST - 0.5)] = 0
            flat = gain.reshape(count, -1)
            best = flat.argmax(axis=1)
            better = np.flatnonzero(flat[np.arange(count), best] > 1e-9)
            feature[first + better], border[first + better] = feature_of[best[better] // (BINS + 1)], best[better] % (BINS + 1)
            at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > border[at])
        leaf = at - inner
        sum_g, sum_h = (np.bincount(leaf, weights=w, minlength=1 << DEPTH) for w in weights[:2])
        value = -SHRINK * sum_g / (sum_h + RIDGE)
        logit += value[leaf]
        forest.feature.append(feature)
        forest.border.append(border)
        forest.value.append(value)
    return forest
