"""A generalised additive model with pairwise interactions over binned features.

Training cycles over the features; each turn fits a shallow tree to the gradient of one feature's bins
and adds its leaves to that feature's lookup table.  Then the pairs that explain most of what is left get
two-way tables in the same way.  A score is a sum of table entries, so it is a few vectorised lookups.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np


def _best_split(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins; place k: bins below k go left."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + smooth) + (all_g - left_g) ** 2 / (all_h - left_h + smooth) - all_g**2 / (all_h + smooth)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def tree(g: np.ndarray, h: np.ndarray, leaves: int, smooth: float) -> np.ndarray:
    """Leaf values per bin of a tree over one feature's bins, grown by the best gain."""
    cuts = [(0, len(g))]
    for _ in range(leaves - 1):
        found = [(*_best_split(g[a:b], h[a:b], smooth), i) for i, (a, b) in enumerate(cuts)]
        gain, k, i = max(found)
        if gain <= 1e-9:
            break
        a, b = cuts[i]
        cuts[i : i + 1] = [(a, a + k), (a + k, b)]
    out = np.empty(len(g))
    for a, b in cuts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + smooth)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, smooth: float) -> np.ndarray:
    """Leaf values of a tree of two levels over a grid: one cut of an axis, one cut of the other in each half."""
    best, value = -1.0, np.zeros_like(g)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for k in range(1, a.shape[0]):
            halves = [(a[:k].sum(0), b[:k].sum(0)), (a[k:].sum(0), b[k:].sum(0))]
            found = [_best_split(x, y, smooth) for x, y in halves]
            score = sum(gain + x.sum() ** 2 / (y.sum() + smooth) for (gain, _), (x, y) in zip(found, halves, strict=True))
            if score > best:
                out = np.empty_like(a)
                for rows, (_, cut), (x, y) in zip((slice(0, k), slice(k, None)), found, halves, strict=True):
                    for cols in (slice(0, cut), slice(cut, None)) if cut else (slice(None),):
                        out[rows, cols] = -x[cols].sum() / (y[cols].sum() + smooth)
                best, value = score, out if axis == 0 else out.T
    return value


@dataclass
class Gam:
    """Cuts and tables; a null or missing feature value counts as 0."""

    cuts: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of feature values."""
        x = np.nan_to_num(np.asarray(x, float))
        bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]
        total = np.full(len(x), self.base)
        for t, b in zip(self.tables, bins, strict=True):
            total += t[b]
        if self.pairs:
            rough = [m[b] for m, b in zip(self.coarse, bins, strict=True)]
            for (i, j), t in self.pairs.items():
                total += t[rough[i], rough[j]]
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 32, coarse: int = 8, rounds: int = 150, pairs: int = 6, pair_rounds: int = 60, rate: float = 0.1, leaves: int = 3, smooth: float = 1.0) -> Gam:
    """Fit on rows of features and labels 0 or 1.  Without rows of both kinds the score is constant."""
    x, y = np.nan_to_num(np.asarray(x, float)), np.asarray(y, float)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for j in range(x.shape[1])]
    at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    sizes = [len(c) + 1 for c in cuts]
    model = Gam(cuts, base, [np.zeros(n) for n in sizes], [np.arange(n) * coarse // n for n in sizes])
    if len(set(y.tolist())) < 2:
        return model
    total = np.full(len(y), base)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-total))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, n in enumerate(sizes):
            g, h = gradient()
            step = rate * tree(np.bincount(at[j], g, n), np.bincount(at[j], h, n), leaves, smooth)
            model.tables[j] += step
            total += step[at[j]]
    rough = [m[b] for m, b in zip(model.coarse, at, strict=True)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(rough[i] * coarse + rough[j], v, coarse * coarse).reshape(coarse, coarse)

    g, h = gradient()
    gains = {(i, j): float((grid(i, j, g) * pair_tree(grid(i, j, g), grid(i, j, h), smooth)).sum()) for i, j in combinations(range(x.shape[1]), 2)}
    for pair in sorted(gains, key=lambda p: (gains[p], p))[:pairs]:
        model.pairs[pair] = np.zeros((coarse, coarse))
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            g, h = gradient()
            step = rate * pair_tree(grid(i, j, g), grid(i, j, h), smooth)
            table += step
            total += step[rough[i], rough[j]]
    return model
