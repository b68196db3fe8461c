"""Histogram gradient-boosted trees in numpy, flattened into arrays for traversal.

Every tree is a full binary tree of one depth, so a row goes down all levels by array lookups;
a node that gains nothing by a split sends all rows to the left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """``features, cuts``: (trees, inner nodes); ``leaves``: (trees, 2 ** depth)."""

    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.leaves.shape[1]))
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (len(leaf) - 1)]
        return out

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    *,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 64,
    l2: float = 1.0,
    least: float = 4.0,
    weight: np.ndarray | None = None,
) -> Forest:
    """Boosted trees for 0/1 labels by logistic loss.

    Without rows, or with one label only, the forest is a constant near that label.
    """
    n, width = x.shape
    inner, leaves = (1 << depth) - 1, 1 << depth
    weight = np.ones(n) if weight is None else weight
    share = (float((weight * y).sum()) + 0.5) / (float(weight.sum()) + 1.0)
    base = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        empty = np.zeros((0, inner))
        return Forest(empty.astype(np.int64), empty, np.zeros((0, leaves)), base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    coded = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    raw = np.full(n, base)
    features = np.zeros((trees, inner), dtype=np.int64)
    cuts = np.full((trees, inner), np.inf)
    values = np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = weight * (p - y), np.maximum(weight * p * (1 - p), 1e-9)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            local = node - first
            best = np.zeros(count)
            for f in range(width):
                cell = local * bins + coded[:, f]
                g = np.bincount(cell, grad, count * bins).reshape(count, bins).cumsum(axis=1)
                h = np.bincount(cell, hess, count * bins).reshape(count, bins).cumsum(axis=1)
                gl, hl = g[:, :-1], h[:, :-1]
                gr, hr = g[:, -1:] - gl, h[:, -1:] - hl
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - g[:, -1:] ** 2 / (h[:, -1:] + l2)
                gain = np.where((hl >= least / 4) & (hr >= least / 4), gain, 0.0)
                gain = gain[:, : len(edges[f])]
                if gain.shape[1] == 0:
                    continue
                at = gain.argmax(axis=1)
                better = gain[np.arange(count), at] > best + 1e-9
                best = np.where(better, gain[np.arange(count), at], best)
                features[t, first : first + count][better] = f
                cuts[t, first : first + count][better] = edges[f][at[better]]
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > cuts[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        values[t] = -rate * g / (h + l2)
        raw += values[t][leaf]
    return Forest(features, cuts, values, base)
