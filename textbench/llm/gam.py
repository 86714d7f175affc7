"""Additive model with pairwise interactions, fitted by cyclic boosting.

Each step fits a shallow tree to one feature (up to four leaves over its bins)
or one pair of features (one cut on each axis) and adds it, damped, to that
feature's or pair's lookup table. A score is a sum of table entries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_RIDGE = 1.0


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _cut(g: np.ndarray, h: np.ndarray, low: int, high: int) -> tuple[float, int]:
    """Best gain of a cut of bins [low, high), and where."""
    if high - low < 2:
        return 0.0, low
    a, b = np.cumsum(g[low:high]), np.cumsum(h[low:high])
    left = a[:-1] ** 2 / (b[:-1] + _RIDGE)
    right = (a[-1] - a[:-1]) ** 2 / (b[-1] - b[:-1] + _RIDGE)
    gain = left + right - a[-1] ** 2 / (b[-1] + _RIDGE)
    k = int(np.argmax(gain))
    return float(gain[k]), low + k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value per bin of a tree of depth two."""
    gain, middle = _cut(g, h, 0, len(g))
    edges = [0, len(g)]
    if gain > 1e-9:
        edges = [0, middle, len(g)]
        for low, high in ((0, middle), (middle, len(g))):
            more, at = _cut(g, h, low, high)
            if more > 1e-9:
                edges.append(at)
        edges = sorted(set(edges))
    out = np.empty(len(g))
    for low, high in zip(edges[:-1], edges[1:]):
        out[low:high] = g[low:high].sum() / (h[low:high].sum() + _RIDGE)
    return out


def _grid(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per cell of the best tree with one cut on each axis."""
    a = np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    b = a.copy()
    a[1:, 1:], b[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    def corners(t):
        low = t[1:-1, 1:-1]
        return low, t[1:-1, -1:] - low, t[-1:, 1:-1] - low, t[-1, -1] - t[1:-1, -1:] - t[-1:, 1:-1] + low
    gain = sum(x**2 / (y + _RIDGE) for x, y in zip(corners(a), corners(b)))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty(g.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for columns in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, columns] = g[rows, columns].sum() / (h[rows, columns].sum() + _RIDGE)
    return out


@dataclass
class Gam:
    bins: int = 32
    pair_bins: int = 8
    rounds: int = 120
    pair_rounds: int = 60
    pairs: int = 8
    rate: float = 0.2
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def _edges(self, x: np.ndarray, bins: int) -> list[np.ndarray]:
        cuts = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0)
        return [np.unique(cuts[:, k]) for k in range(x.shape[1])]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        """Fit to 0/1 outcomes. No rows: every score is one half; one outcome: its smoothed share."""
        y = y.astype(float)
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.intercept = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return self
        self.edges = self._edges(x, self.bins)
        place = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        f = np.full(len(y), self.intercept)
        for _ in range(self.rounds):
            for k, at in enumerate(place):
                p = _sigmoid(f)
                size = len(self.tables[k])
                step = self.rate * _tree(
                    np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size)
                )
                self.tables[k] += step
                f += step[at]
        self.pair_edges = self._edges(x, self.pair_bins)
        wide = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.pair_edges)]

        def sums(i, j):
            p = _sigmoid(f)
            shape = (len(self.pair_edges[i]) + 1, len(self.pair_edges[j]) + 1)
            cell = wide[i] * shape[1] + wide[j]
            size = shape[0] * shape[1]
            g, h = np.bincount(cell, y - p, size), np.bincount(cell, p * (1 - p), size)
            return g.reshape(shape), h.reshape(shape)

        gains = {}
        for i in range(len(wide)):
            for j in range(i + 1, len(wide)):
                if len(self.pair_edges[i]) and len(self.pair_edges[j]):
                    g, h = sums(i, j)
                    gains[i, j] = float((g**2 / (h + _RIDGE)).sum())
        chosen = sorted(gains, key=lambda ij: (-gains[ij], ij))[: self.pairs]
        for ij in chosen:
            self.pair_tables[ij] = np.zeros([len(self.pair_edges[k]) + 1 for k in ij])
        for _ in range(self.pair_rounds):
            for i, j in chosen:
                step = self.rate * _grid(*sums(i, j))
                self.pair_tables[i, j] += step
                f += step[wide[i], wide[j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of outcome 1, by table lookups and additions."""
        f = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            f += table[np.searchsorted(self.edges[k], x[:, k], "right")]
        used = {k for ij in self.pair_tables for k in ij}
        wide = {k: np.searchsorted(self.pair_edges[k], x[:, k], "right") for k in used}
        for (i, j), table in self.pair_tables.items():
            f += table[wide[i], wide[j]]
        return _sigmoid(f)
