"""Gradient-boosted trees on small labelled samples, applied as Catalyst expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A leaf is a number; a split is (feature, threshold, tree if feature <= threshold, tree otherwise).
Tree = float | tuple


@dataclass(frozen=True)
class Forest:
    features: tuple[str, ...]
    bias: float
    trees: list[Tree] = field(hash=False)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for tree in self.trees:
            out += _apply(tree, x)
        return out

    def column(self, feature) -> Column:
        """The margin as an expression; ``feature(name)`` gives a feature's column."""
        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + self._tree(tree, feature)
        return total

    def _tree(self, tree: Tree, feature) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        k, cut, low, high = tree
        return F.when(feature(self.features[k]) <= F.lit(cut), self._tree(low, feature)).otherwise(self._tree(high, feature))


def _apply(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    k, cut, low, high = tree
    return np.where(x[:, k] <= cut, _apply(low, x), _apply(high, x))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, ridge: float = 1.0, least: int = 8) -> Tree:
    def leaf() -> float:
        return round(float(rate * g.sum() / (h.sum() + ridge)), 6)

    if depth == 0 or len(g) < 2 * least:
        return leaf()
    best, gain = None, 1e-6
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v, cg, ch = x[order, k], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= least) & (len(v) - at - 1 >= least)]
        if not len(at):
            continue
        score = cg[at] ** 2 / (ch[at] + ridge) + (cg[-1] - cg[at]) ** 2 / (ch[-1] - ch[at] + ridge) - whole
        i = int(np.argmax(score))
        if score[i] > gain:
            gain, best = score[i], (k, float((v[at[i]] + v[at[i] + 1]) / 2))
    if best is None:
        return leaf()
    low = x[:, best[0]] <= best[1]
    return (*best, _grow(x[low], g[low], h[low], depth - 1, rate), _grow(x[~low], g[~low], h[~low], depth - 1, rate))


def fit(x: np.ndarray, y: np.ndarray, features: tuple[str, ...], rounds: int = 30, depth: int = 3, rate: float = 0.3) -> Forest:
    """Logistic boosting on a sample that the caller bounds."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    bias = round(float(np.log(share / (1 - share))), 6)
    margin, trees = np.full(len(y), bias), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, y - p, p * (1 - p), depth, rate)
        trees.append(tree)
        margin += _apply(tree, x)
    return Forest(features, bias, trees)


def calibrate(margin: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest margin from which held-out rows reach the precision; infinity if none does."""
    order = np.argsort(-margin, kind="stable")
    m, hits = margin[order], np.cumsum(y[order])
    ends = np.concatenate([m[1:] < m[:-1], [True]]) if len(m) else np.zeros(0, bool)
    good = np.flatnonzero(ends & (hits >= precision * np.arange(1, len(m) + 1)))
    return float(m[good[-1]]) if len(good) else float("inf")
