"""Gradient-boosted trees for two classes on a bounded sample: histograms of binned features, logistic loss."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees in heap order; ``cut`` is infinite where a node was not split."""

    base: float
    feature: np.ndarray  # tree x inner node
    cut: np.ndarray
    leaf: np.ndarray  # tree x leaf

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            while inner and at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 5, rate: float = 0.25, bins: int = 32, penalty: float = 1.0, least: float = 3.0) -> Trees:
    """Newton boosting: each split maximises the gain of G^2 / (H + penalty); ties go to the first feature and the lowest cut."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    if n == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    code = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)], 1)
    logit = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-6)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                m = len(cuts[f]) + 1
                cell = (at - first) * m + code[:, f]
                hist = [np.bincount(cell, w, nodes * m).reshape(nodes, m) for w in (g, h)]
                left_g, left_h = (np.cumsum(a, 1)[:, :-1] for a in hist)
                all_g, all_h = (a.sum(1)[:, None] for a in hist)
                right_g, right_h = all_g - left_g, all_h - left_h
                gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - all_g**2 / (all_h + penalty)
                gain[(left_h < least) | (right_h < least)] = -1
                top = gain.argmax(1)
                value = gain[np.arange(nodes), top]
                better = value > best + 1e-9
                best[better] = value[better]
                feature[first : first + nodes][better] = f
                cut[first : first + nodes][better] = cuts[f][top[better]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaf_g, leaf_h = (np.bincount(at - inner, w, leaves) for w in (g, h))
        leaf = -rate * leaf_g / (leaf_h + penalty)
        logit += leaf[at - inner]
        features.append(feature)
        thresholds.append(cut)
        values.append(leaf)
    return Trees(base, np.array(features), np.array(thresholds), np.array(values))
