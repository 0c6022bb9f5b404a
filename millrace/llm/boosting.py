"""Small learners in numpy: gradient-boosted regression trees and logistic regression."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Gradient-boosted trees of depth ``depth`` for a binary target, on binned features."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.25
    bins: int = 32
    bounds: list[np.ndarray] = field(default_factory=list)
    trees: list[list[tuple[int, int, float]]] = field(default_factory=list)  # nodes in heap order: feature (-1: leaf), bin, value
    base: float = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, x[:, i], side="left") for i, b in enumerate(self.bounds)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.bounds = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, self.bins + 1)[1:-1])) for i in range(x.shape[1])]
        b = self._binned(x)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            tree: list[tuple[int, int, float]] = [(-1, 0, 0.0)] * (2 ** (self.depth + 1) - 1)
            members = {0: np.arange(len(y))}
            for node in range(len(tree)):
                rows = members.get(node)
                if rows is None:
                    continue
                g, h = grad[rows].sum(), hess[rows].sum()
                tree[node] = (-1, 0, self.rate * g / (h + 1.0))
                if node >= 2**self.depth - 1 or len(rows) < 20:
                    continue
                best = (1e-6, -1, 0)
                for f in range(x.shape[1]):
                    size = len(self.bounds[f]) + 1
                    gs = np.cumsum(np.bincount(b[rows, f], weights=grad[rows], minlength=size))[:-1]
                    hs = np.cumsum(np.bincount(b[rows, f], weights=hess[rows], minlength=size))[:-1]
                    if len(gs):
                        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                        k = int(gain.argmax())
                        best = max(best, (float(gain[k]), f, k))
                if best[1] >= 0:
                    _, f, k = best
                    tree[node] = (f, k, 0.0)
                    left = b[rows, f] <= k
                    members[2 * node + 1], members[2 * node + 2] = rows[left], rows[~left]
            self.trees.append(tree)
            score += self._tree(tree, b)
        return self

    def _tree(self, tree: list[tuple[int, int, float]], b: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array(c) for c in zip(*tree))
        node = np.zeros(len(b), dtype=np.int64)
        for _ in range(self.depth):
            f = feature[node]
            go = f >= 0
            right = b[np.arange(len(b)), np.maximum(f, 0)] > cut[node]
            node = np.where(go, 2 * node + 1 + right, node)
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the target."""
        if not len(x):
            return np.zeros(0)
        b = self._binned(x)
        return 1 / (1 + np.exp(-(self.base + sum(self._tree(t, b) for t in self.trees))))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 400, decay: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression; the last one is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w, past = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + decay * w
        past += grad * grad
        w -= 0.3 * grad / np.sqrt(past)
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Probabilities by ``fit_logistic``'s weights."""
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
