"""Small gradient-boosted trees for a yes or no label: fitted with NumPy on a bounded sample, applied as a Column."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A leaf's value, or (feature, limit, tree up to the limit, tree above it).
Tree = float | tuple


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: int, ridge: float) -> Tree:
    leaf = float(grad.sum() / (hess.sum() + ridge))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    score = lambda g, h: g * g / (h + ridge)
    best, whole = (1e-6, 0, 0.0), score(grad.sum(), hess.sum())
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, g, h = x[order, f], np.cumsum(grad[order]), np.cumsum(hess[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut + 1 >= least) & (cut + 1 <= len(x) - least)]
        if len(cut):
            gain = score(g[cut], h[cut]) + score(g[-1] - g[cut], h[-1] - h[cut]) - whole
            k = int(np.argmax(gain))
            best = max(best, (float(gain[k]), f, float(v[cut[k]] + v[cut[k] + 1]) / 2))
    _, f, limit = best
    left = x[:, f] <= limit
    if best[0] <= 1e-6 or left.all() or not left.any():
        return leaf
    part = lambda m: _grow(x[m], grad[m], hess[m], depth - 1, least, ridge)
    return f, limit, part(left), part(~left)


def _leaf(tree: Tree, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


class Boosted:
    """Logistic boosting; ``threshold`` is set so that held-out rows at or above it reach ``precision``."""

    def __init__(self, trees: int = 30, depth: int = 3, rate: float = 0.3, least: int = 10, ridge: float = 1.0, precision: float = 0.98):
        self.n, self.depth, self.rate, self.least, self.ridge, self.precision = trees, depth, rate, least, ridge, precision
        self.trees: list[Tree] = []
        self.threshold, self.held_out = 0.0, (0.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        held = np.arange(len(x)) % 5 == 0
        a, b = x[~held], y[~held]
        margin = np.zeros(len(a))
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-margin))
            tree = _grow(a, b - p, p * (1 - p), self.depth, self.least, self.ridge)
            self.trees.append(tree)
            margin += self.rate * np.array([_leaf(tree, r) for r in a])
        s, t = self.margins(x[held]), y[held]
        order = np.argsort(-s, kind="stable")
        right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        last = np.append(s[order][1:] < s[order][:-1], True)  # rows of equal scores are chosen together
        good = np.flatnonzero((right >= self.precision) & last)
        self.threshold = float(s[order][good[-1]]) if len(good) else float("inf")
        chosen = s >= self.threshold
        self.held_out = (float(t[chosen].mean()) if chosen.any() else 1.0, float(t[chosen].sum() / max(1, t.sum())))
        return self

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.array([self.rate * sum(_leaf(t, r) for t in self.trees) for r in x])

    def column(self, feature: Callable[[int], Column]) -> Column:
        """The margin, from one Column a feature."""

        def of(tree: Tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(self.rate * tree)
            return F.when(feature(tree[0]) <= tree[1], of(tree[2])).otherwise(of(tree[3]))

        total = of(self.trees[0])
        for t in self.trees[1:]:
            total = total + of(t)
        return total
