"""Gradient-boosted trees for two classes, on binned features, with calibrated probabilities."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Newton boosting of the logistic loss; every tree is complete to ``depth`` levels."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b, (n, m), width = self._binned(x), x.shape, self.bins + 1
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        raw, self.forest = np.full(n, self.base), []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node, splits = np.zeros(n, np.int64), []
            for level in range(self.depth):
                size = 1 << level
                best = np.full(size, 1e-9), np.zeros(size, np.int64), np.full(size, width, np.int64)
                for f in range(m):
                    cell = node * width + b[:, f]
                    gs = np.bincount(cell, g, size * width).reshape(size, width)
                    hs = np.bincount(cell, h, size * width).reshape(size, width)
                    gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                    gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    at = gain.argmax(1)
                    top = gain[np.arange(size), at]
                    better = top > best[0]
                    for old, new in zip(best, (top, np.full(size, f), at)):
                        old[better] = new[better]
                splits.append((best[1], best[2]))
                node = 2 * node + (b[np.arange(n), best[1][node]] > best[2][node])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            self.forest.append((splits, value))
            raw += value[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out, row = self._binned(x), np.full(len(x), self.base), np.arange(len(x))
        for splits, value in self.forest:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = 2 * node + (b[row, feature[node]] > cut[node])
            out += value[node]
        return out


class Calibrated:
    """A boosted model with a logistic calibration and a threshold for each group of rows (``of``).

    Both are learned on rows the model has not seen, a half each: a group's threshold is the
    calibrated probability that selects the most right rows at a precision of ``precision``; without such a probability
    nothing of the group is selected. ``precision_held`` and ``recall_held`` are measured on a last
    part that nothing was learned from.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, of: np.ndarray, precision: float, seed: int = 7):
        part = np.random.default_rng(seed).permutation(len(y)) % 6
        self.model = BoostedTrees().fit(x[part < 3], y[part < 3])
        groups = int(of.max()) + 1
        self.scale, self.threshold = np.tile([1.0, 0.0], (groups, 1)), np.full(groups, 2.0)
        z = self.model.raw(x)
        for g in range(groups):
            mine = (part == 3) & (of == g)
            if mine.any():
                self.scale[g] = self._calibrated(z[mine], y[mine])
            mine = (part == 4) & (of == g)
            if mine.any():
                self.threshold[g] = self._lowest(self._of(z[mine], of[mine]), y[mine], precision)
        last = part == 5
        chosen = self._of(z[last], of[last]) >= self.threshold[of[last]]
        right = chosen & (y[last] > 0)
        count = lambda mask: np.maximum(np.bincount(of[last][mask], minlength=groups), 1)
        self.precision_held, self.recall_held = np.bincount(of[last][right], minlength=groups) / count(chosen), np.bincount(of[last][right], minlength=groups) / count(y[last] > 0)

    @staticmethod
    def _calibrated(z: np.ndarray, t: np.ndarray) -> tuple[float, float]:
        """Newton's method for the two parameters, held near (1, 0) where rows are few."""
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * z + b)))
            w = p * (1 - p) + 1e-9
            g = np.array([((t - p) * z).sum() - 0.1 * (a - 1), (t - p).sum() - 0.1 * b])
            h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
            step = np.linalg.solve(h, g)
            a, b = a + step[0], b + step[1]
        return a, b

    @staticmethod
    def _lowest(p: np.ndarray, t: np.ndarray, precision: float) -> float:
        order = np.argsort(-p, kind="stable")
        good = np.cumsum(t[order]) / np.arange(1, len(order) + 1) >= precision
        good &= np.append(p[order][1:] < p[order][:-1], True)  # rows of one probability are selected together
        if not good.any():
            return 2.0
        # of those, the first that selects as many right rows as any: what only adds wrong ones stays out
        last = np.flatnonzero(good & (np.cumsum(t[order]) == np.cumsum(t[order])[good].max()))[0]
        below = p[order][last + 1] if last + 1 < len(p) else p[order][last]
        return float((p[order][last] + below) / 2)  # half way to the first that is not selected

    def _of(self, z: np.ndarray, of: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale[of, 0] * z + self.scale[of, 1])))

    def probability(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return self._of(self.model.raw(x), of)
