"""Gradient-boosted trees for two classes on numpy arrays: logistic loss, histogram splits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth, a row per tree."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner, rows = self.feature.shape[1], np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 5.0) -> Trees:
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    prior = float(np.average(y, weights=weight))
    base = float(np.log(prior / (1 - prior)))
    logit, inner = np.full(n, base), 2**depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-logit))
        g, h = weight * (y - p), weight * p * (1 - p)
        at, f, c = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = (1e-6, 0, np.inf, None)
            if len(rows) > 1:
                gs, hs = g[rows].sum(), h[rows].sum()
                for j in range(width):
                    b = binned[rows, j]
                    gl = np.cumsum(np.bincount(b, g[rows], len(cuts[j]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], len(cuts[j]) + 1))[:-1]
                    if len(gl):
                        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (gain[k], j, cuts[j][k], k)
            f[node], c[node] = best[1], best[2]
            at[rows] = 2 * node + 1 + ((binned[rows, best[1]] > best[3]) if best[3] is not None else 0)
        leaf = rate * np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + ridge)
        logit += leaf[at - inner]
        features.append(f)
        thresholds.append(c)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)
