"""Generalised additive model with pairwise interactions, boosted cyclically with shallow trees (numpy).

Each feature is cut into quantile bins. A round visits the features in turn; each visit fits a tree of depth two to the
histogram of gradients over the bins and adds its leaves to the feature's lookup table. Then the pairs whose residual a
four-cell cut explains best get two-dimensional tables the same way. Scoring is a sum of looked-up bin values.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np

BINS, PAIR_BINS, PAIRS = 48, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, RIDGE, LEAST = 160, 60, 0.1, 2.0, 8.0


def _edges(v: np.ndarray) -> np.ndarray:
    """Cuts half way between neighbouring quantiles, so that unseen values between two of them go to the nearer."""
    q = np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1))) if len(v) else np.zeros(0)
    return (q[1:] + q[:-1]) / 2


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain and place of one cut of a histogram; bins before the place go left."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gt, ht = g.sum(), h.sum()
    gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values of a shallow tree over the bins."""
    gain, k = _cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), -g.sum() / (h.sum() + RIDGE))
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best cut along the first axis with a cut of each side along the second."""
    best, k = _cut(g.sum(1), h.sum(1))
    k = k or 1
    out, gain = np.empty_like(g), best
    for part in (slice(None, k), slice(k, None)):
        a, b = g[part].sum(0), h[part].sum(0)
        gain += _cut(a, b)[0]
        out[part] = _tree(a, b, 1)[None, :]
    return gain, out


@dataclass
class PairwiseGam:
    intercept: float = 0.0
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)
    pair_tables: list = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), int)

    def _coarse(self, bins: np.ndarray, j: int) -> np.ndarray:
        return bins[:, j] * PAIR_BINS // (len(self.edges[j]) + 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> PairwiseGam:
        n = len(y)
        rate = (y.sum() + 1.0) / (n + 2.0)
        self.intercept = float(np.log(rate / (1 - rate)))
        self.edges = [_edges(x[:, j]) for j in range(x.shape[1])]
        bins = self.bins(x)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        if n < 2:
            return self
        f = np.full(n, self.intercept)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-f))
            return p - y, np.maximum(p * (1 - p), 1e-6)

        for _ in range(ROUNDS):
            for j, t in enumerate(self.tables):
                g, h = slopes()
                step = RATE * _tree(np.bincount(bins[:, j], g, len(t)), np.bincount(bins[:, j], h, len(t)))
                t += step
                f += step[bins[:, j]]
        coarse = [self._coarse(bins, j) for j in range(x.shape[1])]
        g, h = slopes()

        def grid(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = coarse[a] * PAIR_BINS + coarse[b]
            return tuple(np.bincount(at, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h))

        ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda ab: -_quadrants(*grid(*ab, g, h))[0])
        self.pairs = ranked[:PAIRS]
        self.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for (a, b), t in zip(self.pairs, self.pair_tables):
                step = RATE * _quadrants(*grid(a, b, *slopes()))[1]
                t += step
                f += step[coarse[a], coarse[b]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        bins = self.bins(x)
        f = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            f += t[bins[:, j]]
        for (a, b), t in zip(self.pairs, self.pair_tables):
            f += t[self._coarse(bins, a), self._coarse(bins, b)]
        return 1 / (1 + np.exp(-f))
