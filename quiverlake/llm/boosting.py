"""Small numpy learners: gradient-boosted trees on binned features, and isotonic calibration."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Binary logistic boosting with histogram splits and trees of equal depth."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 20, l2: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.least, self.l2 = trees, depth, rate, bins, least, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(col, quantiles)) for col in x.T]
        codes = np.stack([np.searchsorted(e, col, "right") for e, col in zip(self.edges, x.T, strict=True)], axis=1)
        mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(mean / (1 - mean)))
        raw = np.full(len(y), self.base)
        self.splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-raw))
            feature, cut, leaf, node = self._tree(codes, p - y, p * (1 - p))
            self.splits.append((feature, cut, leaf))
            raw += leaf[node]
        return self

    def _tree(self, codes, grad, hess):
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.iinfo(np.int64).max)
        node = np.zeros(len(grad), np.int64)
        for level in range(self.depth):
            begin, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for f in range(codes.shape[1]):
                size = len(self.edges[f]) + 1
                key = (node - begin) * size + codes[:, f]
                g, h, c = (np.bincount(key, w, width * size).reshape(width, size) for w in (grad, hess, None))
                gl, hl, cl = (np.cumsum(a, axis=1)[:, :-1] for a in (g, h, c))
                gt, ht, ct = (a.sum(axis=1, keepdims=True) for a in (g, h, c))
                if not gl.size:
                    continue
                score = lambda a, b: a * a / (b + self.l2)
                gain = score(gl, hl) + score(gt - gl, ht - hl) - score(gt, ht)
                gain[(cl < self.least) | (ct - cl < self.least)] = -1
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                feature[begin : begin + width][better] = f
                cut[begin : begin + width][better] = at[better]
            go = codes[np.arange(len(node)), feature[node]] > cut[node]
            node = 2 * node + 1 + go
        node = node - inner
        leaves = 2**self.depth
        g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
        return feature, cut, -self.rate * g / (h + self.l2), node

    def raw(self, x: np.ndarray) -> np.ndarray:
        codes = np.stack([np.searchsorted(e, col, "right") for e, col in zip(self.edges, x.T, strict=True)], axis=1) if len(x) else np.zeros((0, len(self.edges)), np.int64)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.splits:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (codes[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


class Isotonic:
    """The non-decreasing step function nearest to the labels, joined by straight lines."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        total, weight, at = [], [], []
        for s, v in zip(score[order], y[order].astype(float), strict=True):
            total.append(v)
            weight.append(1.0)
            at.append(s)
            while len(total) > 1 and total[-2] / weight[-2] >= total[-1] / weight[-1]:
                v, w, a = total.pop(), weight.pop(), at.pop()
                at[-1] = (at[-1] * weight[-1] + a * w) / (weight[-1] + w)
                total[-1] += v
                weight[-1] += w
        self.at, self.value = np.array(at), np.array(total) / np.array(weight)
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.value) if len(self.at) else np.zeros(len(score))
