"""Gradient-boosted trees in numpy: histogram splits, monotone constraints, flat node arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees in flat arrays of shape ``(trees, nodes)``; a leaf is its own left and right child."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Every row walks all trees at once, one level per step."""
        trees = np.arange(self.feature.shape[0])[None, :]
        node = np.zeros((len(x), self.feature.shape[0]), np.int32)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[trees, node]] <= self.threshold[trees, node]
            node = np.where(goes_left, self.left[trees, node], self.right[trees, node])
        return 1 / (1 + np.exp(-(self.base + self.value[trees, node].sum(axis=1))))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: np.ndarray,
    *,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    least: int = 20,
    ridge: float = 1.0,
) -> Forest:
    """Logistic boosting. ``monotone`` holds -1, 0 or 1 per feature: how the probability may move with it.

    A split on a constrained feature is taken only if its children's values stand in the right order, and
    the middle of the two bounds all nodes below, so the whole forest is monotone. Without rows of both classes
    the forest has no splits.
    """
    n, features = x.shape
    share = (y.sum() + 1.0) / (n + 2.0) if n else 0.5
    base, size = float(np.log(share / (1 - share))), 2 ** (depth + 1) - 1
    flat = {k: np.zeros((trees, size), t) for k, t in (("feature", np.int32), ("threshold", float), ("value", float))}
    own = np.tile(np.arange(size, dtype=np.int32), (trees, 1))
    left, right = own.copy(), own.copy()
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(features)]
        binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(features)])
        margin = np.full(n, base)
        for t in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
            todo = [(0, np.arange(n), -np.inf, np.inf, 0)]
            while todo:
                node, rows, low, high, level = todo.pop()
                g, h = grad[rows], hess[rows]
                flat["value"][t, node] = rate * np.clip(g.sum() / (h.sum() + ridge), low, high)
                best = _split(binned, edges, rows, g, h, monotone, low, high, bins, least, ridge) if level < depth else None
                if best is None:
                    margin[rows] += flat["value"][t, node]
                    continue
                f, cut, lo_value, hi_value = best
                flat["feature"][t, node], flat["threshold"][t, node] = f, edges[f][cut]
                left[t, node], right[t, node] = 2 * node + 1, 2 * node + 2
                below = binned[f, rows] <= cut
                bounds = [(low, high), (low, high)]
                if monotone[f]:
                    middle = (lo_value + hi_value) / 2
                    bounds = [(low, middle), (middle, high)][:: int(monotone[f])]
                todo.append((2 * node + 1, rows[below], *bounds[0], level + 1))
                todo.append((2 * node + 2, rows[~below], *bounds[1], level + 1))
    return Forest(base, flat["feature"], flat["threshold"], left, right, flat["value"], depth)


def _split(binned, edges, rows, g, h, monotone, low, high, bins, least, ridge):
    """The best admissible split of a node: ``feature, bin, value left, value right``."""
    best, gain = None, 1e-6
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for f in range(len(binned)):
        if not len(edges[f]):
            continue
        code = binned[f, rows]
        gl = np.cumsum(np.bincount(code, g, bins))[: len(edges[f])]
        hl = np.cumsum(np.bincount(code, h, bins))[: len(edges[f])]
        nl = np.cumsum(np.bincount(code, minlength=bins))[: len(edges[f])]
        gr, hr = g.sum() - gl, h.sum() - hl
        vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
        won = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - whole
        won[(nl < least) | (len(rows) - nl < least) | (monotone[f] * (vr - vl) < 0)] = -1
        k = int(won.argmax())
        if won[k] > gain:
            best, gain = (f, k, float(vl[k]), float(vr[k])), won[k]
    return best
