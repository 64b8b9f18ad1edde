"""Gradient-boosted trees on a table of counted cells, and their SQL expression.

The rows to learn from are counted by their binned features beforehand (in Spark), so
the table has at most as many rows as there are bins in combination, whatever the data.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class BoostedTrees:
    """Logistic boosting with trees of depth 2 that split where a feature's bin is exceeded."""

    def __init__(self, names: list[str], rounds: int = 30, rate: float = 0.4, least: float = 1.0):
        self.names, self.rounds, self.rate, self.least = names, rounds, rate, least
        self.bias, self.trees = 0.0, []

    def _leaf(self, g, h):
        return float(self.rate * g.sum() / (h.sum() + self.least))

    def _split(self, x, g, h):
        """The (feature, bin) of the largest gain among rows, or None."""
        best, gain = None, 1e-9
        base = g.sum() ** 2 / (h.sum() + self.least)
        for f in range(x.shape[1]):
            for b in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= b
                got = sum(g[m].sum() ** 2 / (h[m].sum() + self.least) for m in (low, ~low)) - base
                if got > gain:
                    best, gain = (f, int(b)), got
        return best

    def _grow(self, x, g, h, depth):
        at = self._split(x, g, h) if depth and len(x) else None
        if at is None:
            return self._leaf(g, h) if len(x) else 0.0
        low = x[:, at[0]] <= at[1]
        return (*at, self._grow(x[low], g[low], h[low], depth - 1), self._grow(x[~low], g[~low], h[~low], depth - 1))

    def fit(self, x: np.ndarray, positive: np.ndarray, total: np.ndarray) -> "BoostedTrees":
        rate = (positive.sum() + 1) / (total.sum() + 2)
        self.bias, self.trees = math.log(rate / (1 - rate)), []
        margin = np.full(len(x), self.bias)
        for _ in range(self.rounds if len(x) else 0):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, positive - total * p, total * p * (1 - p), 2)
            self.trees.append(tree)
            margin += [_value(tree, row) for row in x]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.array([1 / (1 + math.exp(-self.bias - sum(_value(t, row) for t in self.trees))) for row in x])

    def column(self, features: Column) -> Column:
        """The score as an expression over a struct of the features' bins."""
        margin = F.lit(self.bias)
        for tree in self.trees:
            margin = margin + self._expression(tree, features)
        return 1 / (1 + F.exp(-margin))

    def _expression(self, tree, features: Column) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        f, b, low, high = tree
        return F.when(features[self.names[f]] <= b, self._expression(low, features)).otherwise(self._expression(high, features))


def _value(tree, row) -> float:
    while isinstance(tree, tuple):
        f, b, low, high = tree
        tree = low if row[f] <= b else high
    return tree
