"""Isolation forest in numpy: random splits of bounded subsamples, path lengths of many rows at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows: the length that a leaf of n rows still hides."""
    n = np.asarray(n, dtype=np.float64)
    m = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as parallel arrays; a leaf points to itself and holds its path length."""

    column: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    depth: int
    sample: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for rows that few splits set apart."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.column[at]] < self.cut[at], self.low[at], self.high[at])
            total += self.length[at]
        return 2.0 ** (-(total / len(self.roots)) / max(float(average_path(self.sample)), 1.0))


def grow(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7) -> Forest:
    """Trees over random subsamples of x; splits fall on columns that vary in the node."""
    rng = np.random.default_rng(seed)
    depth = max(1, int(np.ceil(np.log2(max(sample, 2)))))
    column, cut, low, high, length, roots = [], [], [], [], [], []

    def node() -> int:
        for a in (column, cut, length):
            a.append(0)
        low.append(len(low))
        high.append(len(high))
        return len(low) - 1

    for _ in range(trees):
        roots.append(root := node())
        open_ = [(root, x[rng.choice(len(x), min(sample, len(x)), replace=False)], 0)]
        while open_:
            at, part, level = open_.pop()
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 else []
            if level == depth or not len(spread):
                length[at] = level + float(average_path(len(part)))
                continue
            c = int(rng.choice(spread))
            value = rng.uniform(part[:, c].min(), part[:, c].max())
            column[at], cut[at], low[at], high[at] = c, value, node(), node()
            below = part[:, c] < value
            open_ += [(low[at], part[below], level + 1), (high[at], part[~below], level + 1)]
    return Forest(np.array(column, np.int64), np.array(cut, float), np.array(low, np.int64), np.array(high, np.int64), np.array(length, float), np.array(roots, np.int64), depth, min(sample, len(x)))
