"""Gradient-boosted trees on histograms, with monotonic constraints, flattened into numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All nodes of all trees in five arrays; ``feature`` is -1 at a leaf, whose children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row: every tree takes ``depth`` vectorised steps over all rows."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                left = x[rows, np.maximum(f, 0)] <= self.threshold[node]
                node = np.where(f < 0, node, np.where(left, self.left[node], self.right[node]))
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def constant(p: float, features: int = 0) -> Forest:
    """A model without trees."""
    p = min(max(p, 1e-6), 1 - 1e-6)
    nothing = np.empty(0)
    return Forest(nothing.astype(int), nothing, nothing.astype(int), nothing.astype(int), nothing, nothing.astype(int), 0, float(np.log(p / (1 - p))))


def fit(x: np.ndarray, y: np.ndarray, *, monotone: dict[int, int] | None = None, trees: int = 40, depth: int = 3,
        rate: float = 0.25, bins: int = 64, least: float = 8.0, ridge: float = 1.0) -> Forest:
    """Boost logistic loss.  ``monotone`` maps a feature to +1 or -1: the margin never falls (rises) as it grows.

    A constrained split must order its children's values; both children then inherit the midpoint as a
    bound, so the order also holds below them.
    """
    monotone = monotone or {}
    n, width = x.shape
    p = float(np.mean(y)) if n else 0.5
    model = constant(p)
    if n < 2 * least or p in (0.0, 1.0):
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    code = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)  # code <= k iff x <= cuts[k]
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(n, model.base)
    size = bins + 1
    flat = code + np.arange(width) * size

    def node() -> int:
        for array, x0 in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, 0.0)):
            array.append(x0)
        left[-1] = right[-1] = len(feature) - 1
        return len(feature) - 1

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        me = node()
        g, h = grad[rows], hess[rows]
        total_g, total_h = g.sum(), h.sum()
        value[me] = float(np.clip(-total_g / (total_h + ridge), low, high))
        if level == depth or total_h < 2 * least / 4:
            margin[rows] += rate * value[me]
            value[me] *= rate
            return me
        where = flat[rows].ravel()
        hist_g = np.bincount(where, np.repeat(g, width), minlength=width * size).reshape(width, size).cumsum(1)[:, :-1]
        hist_h = np.bincount(where, np.repeat(h, width), minlength=width * size).reshape(width, size).cumsum(1)[:, :-1]
        right_g, right_h = total_g - hist_g, total_h - hist_h
        v_left, v_right = np.clip(-hist_g / (hist_h + ridge), low, high), np.clip(-right_g / (right_h + ridge), low, high)
        loss = lambda gg, hh, v: gg * v + 0.5 * (hh + ridge) * v * v
        gain = loss(total_g, total_h, value[me]) - loss(hist_g, hist_h, v_left) - loss(right_g, right_h, v_right)
        allowed = (hist_h >= least / 4) & (right_h >= least / 4)
        for f, sign in monotone.items():
            allowed[f] &= sign * (v_right[f] - v_left[f]) >= 0
        for f in range(width):
            allowed[f, len(cuts[f]):] = False
        gain = np.where(allowed, gain, -np.inf)
        best = int(np.argmax(gain))
        if not gain.flat[best] > 1e-6:
            margin[rows] += rate * value[me]
            value[me] *= rate
            return me
        f, k = divmod(best, size - 1)
        goes_left = code[rows, f] <= k
        low_l, high_l, low_r, high_r = low, high, low, high
        if f in monotone:
            middle = (v_left[f, k] + v_right[f, k]) / 2
            if monotone[f] > 0:
                high_l, low_r = middle, middle
            else:
                low_l, high_r = middle, middle
        feature[me], threshold[me], value[me] = f, float(cuts[f][k]), 0.0
        left[me] = grow(rows[goes_left], level + 1, low_l, high_l)
        right[me] = grow(rows[~goes_left], level + 1, low_r, high_r)
        return me

    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        grad, hess = q - y, np.maximum(q * (1 - q), 1e-9)
        roots.append(grow(np.arange(n), 0, -4.0, 4.0))
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth, model.base)
