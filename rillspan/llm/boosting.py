"""Gradient-boosted trees for a few classes on binned features."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Softmax boosting of level-wise trees of a fixed depth.

    Each tree sees a random ``share`` of the rows and of the features.
    """

    def __init__(
        self, x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, lam: float = 2.0,
        share: float = 0.5, seed: int = 9,
    ):
        self.classes, self.depth = classes, depth
        rng = np.random.default_rng(seed)
        grid = np.linspace(0, 1, bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], grid)) for f in range(x.shape[1])]
        binned = self.bin(x)
        n, width = binned.shape
        by_feature = np.ascontiguousarray(binned.T)
        score = np.zeros((n, classes))
        want = np.eye(classes)[y]
        nodes = 2**depth - 1
        self.feature, self.cut, self.leaf = [], [], []
        for _ in range(rounds):
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            rows = np.flatnonzero(rng.random(n) < share)
            some = np.sort(rng.choice(width, max(1, int(width * share)), replace=False))
            sub = by_feature[some][:, rows]
            for c in range(classes):
                g_all, h_all = p[:, c] - want[:, c], np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
                g, h = g_all[rows], h_all[rows]
                feature, cut = np.zeros(nodes, np.int64), np.full(nodes, 255)
                node = np.zeros(len(rows), np.int64)
                for level in range(depth):
                    k = 2**level
                    hg, hh = np.empty((k, len(some), bins)), np.empty((k, len(some), bins))
                    for f, column in enumerate(sub):
                        key = node * bins + column
                        hg[:, f] = np.bincount(key, g, k * bins).reshape(k, bins)
                        hh[:, f] = np.bincount(key, h, k * bins).reshape(k, bins)
                    hg, hh = hg.cumsum(2), hh.cumsum(2)
                    tg, th = hg[:, :1, -1:], hh[:, :1, -1:]
                    gain = hg**2 / (hh + lam) + (tg - hg) ** 2 / (th - hh + lam) - tg**2 / (th + lam)
                    gain[(hh < 1) | (th - hh < 1)] = 0
                    best = gain.reshape(k, -1).argmax(1)
                    good = gain.reshape(k, -1).max(1) > 1e-6
                    f, b = best // bins, np.where(good, best % bins, 255)
                    feature[k - 1 : 2 * k - 1], cut[k - 1 : 2 * k - 1] = some[f], b
                    node = 2 * node + (sub[f[node], np.arange(len(rows))] > b[node])
                size = 2**depth
                leaf = -rate * np.bincount(node, g, size) / (np.bincount(node, h, size) + lam)
                self.feature.append(feature)
                self.cut.append(cut)
                self.leaf.append(leaf)
                score[:, c] += leaf[self._leaves(binned, feature, cut)]

    def _leaves(self, binned: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        node, every = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for level in range(self.depth):
            at = 2**level - 1 + node
            node = 2 * node + (binned[every, feature[at]] > cut[at])
        return node

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], 1)

    def log_proba(self, x: np.ndarray) -> np.ndarray:
        binned = self.bin(x)
        score = np.zeros((len(x), self.classes))
        for t, (feature, cut, leaf) in enumerate(zip(self.feature, self.cut, self.leaf, strict=True)):
            score[:, t % self.classes] += leaf[self._leaves(binned, feature, cut)]
        score -= score.max(1, keepdims=True)
        return score - np.log(np.exp(score).sum(1, keepdims=True))
