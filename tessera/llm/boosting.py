"""A small gradient-boosted tree classifier over numeric features (numpy).

Fitted on a bounded sample; the trees are plain arrays that tasks apply.
"""

from __future__ import annotations

import numpy as np


def _leaf(gradient: np.ndarray, weight: np.ndarray, ridge: float) -> float:
    return float(gradient.sum() / (weight.sum() + ridge))


def _grow(codes, gradient, weight, depth, ridge, bins):
    """A tree as nested tuples: (feature, code, left, right) or a leaf value."""
    if depth == 0 or len(gradient) < 10:
        return _leaf(gradient, weight, ridge)
    total_g, total_w = gradient.sum(), weight.sum()
    best = (1e-6, None, None)
    for j in range(codes.shape[1]):
        g = np.bincount(codes[:, j], gradient, bins).cumsum()[:-1]
        w = np.bincount(codes[:, j], weight, bins).cumsum()[:-1]
        gain = g**2 / (w + ridge) + (total_g - g) ** 2 / (total_w - w + ridge) - total_g**2 / (total_w + ridge)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], j, k)
    if best[1] is None:
        return _leaf(gradient, weight, ridge)
    low = codes[:, best[1]] <= best[2]
    return (
        best[1], best[2],
        _grow(codes[low], gradient[low], weight[low], depth - 1, ridge, bins),
        _grow(codes[~low], gradient[~low], weight[~low], depth - 1, ridge, bins),
    )


def _walk(tree, codes: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    if not isinstance(tree, tuple):
        out[rows] += tree
        return
    low = codes[rows, tree[0]] <= tree[1]
    _walk(tree[2], codes, rows[low], out)
    _walk(tree[3], codes, rows[~low], out)


class BoostedTrees:
    """Logistic boosting with Newton leaves over quantile-binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, bins: int = 32):
        self.rounds, self.depth, self.rate, self.ridge, self.bins = rounds, depth, rate, ridge, bins
        self.edges: list[np.ndarray] = []
        self.trees: list = []
        self.start = 0.0

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)])

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], share)) for j in range(x.shape[1])]
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start, self.trees = float(np.log(rate / (1 - rate))), []
        codes, logits = self._codes(x), np.full(len(y), np.log(rate / (1 - rate)))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-logits))
            tree = _grow(codes, y - p, p * (1 - p), self.depth, self.ridge, self.bins + 1)
            step = np.zeros(len(y))
            _walk(tree, codes, np.arange(len(y)), step)
            logits += self.rate * step
            self.trees.append(tree)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        codes = self._codes(x)
        for tree in self.trees:
            _walk(tree, codes, np.arange(len(x)), total)
        return 1 / (1 + np.exp(-(self.start + self.rate * total)))
