"""Small gradient-boosted trees of depth two, for binary labels."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting over quantile bins; deterministic, no sampling."""

    def __init__(self, rounds: int = 60, rate: float = 0.3, bins: int = 24) -> None:
        self.rounds, self.rate, self.bins = rounds, rate, bins
        self.trees: list[tuple] = []
        self.base = 0.0

    def _split(self, binned: np.ndarray, rows: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> tuple[int, int, float]:
        best = (-1, 0, 0.0)
        g_all, w_all = gradient[rows].sum(), weight[rows].sum() + 1.0
        for f in range(binned.shape[1]):
            b = binned[rows, f]
            g = np.cumsum(np.bincount(b, gradient[rows], self.bins + 1))[:-1]
            w = np.cumsum(np.bincount(b, weight[rows], self.bins + 1))[:-1] + 1.0
            gain = g**2 / w + (g_all - g) ** 2 / (w_all - w + 1.0) - g_all**2 / w_all
            at = int(np.argmax(gain))
            if gain[at] > best[2]:
                best = (f, at, float(gain[at]))
        return best

    def _leaf(self, rows: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> float:
        return self.rate * gradient[rows].sum() / (weight[rows].sum() + 1.0) if len(rows) else 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(self.edges)], 1)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.base)
        every = np.arange(len(y))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            f, at, gain = self._split(binned, every, gradient, weight)
            if gain < 1e-6:
                break
            branches = []
            for side in (binned[:, f] <= at, binned[:, f] > at):
                rows = np.flatnonzero(side)
                f2, at2, gain2 = self._split(binned, rows, gradient, weight)
                if gain2 < 1e-6:
                    f2, at2 = 0, self.bins
                low = rows[binned[rows, f2] <= at2]
                high = rows[binned[rows, f2] > at2]
                leaves = self._leaf(low, gradient, weight), self._leaf(high, gradient, weight)
                score[low] += leaves[0]
                score[high] += leaves[1]
                branches.append((f2, at2, *leaves))
            self.trees.append((f, at, *branches))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        if not len(x):
            return np.empty(0)
        binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(self.edges)], 1)
        score = np.full(len(x), self.base)
        for f, at, low, high in self.trees:
            left = binned[:, f] <= at
            for side, (f2, at2, a, b) in ((left, low), (~left, high)):
                score[side] += np.where(binned[side, f2] <= at2, a, b)
        return 1 / (1 + np.exp(-score))
