"""Gradient-boosted trees with monotonic constraints, as flat numpy node arrays.

A tree of depth d is a full binary tree in heap order: node i has children 2i+1 and 2i+2; ``feature`` and
``cut`` are (trees, 2^d - 1) arrays, ``value`` is (trees, 2^d). A node that isn't split has an infinite cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds for each row of ``x``; all rows go down a tree at once."""
        out, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(inner.bit_length()):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 8.0, ridge: float = 2.0) -> Forest:
    """Boost log-loss for y in {0, 1}. ``signs``: for each feature +1, -1 or 0, the direction its score may take."""
    n, m = x.shape
    p0 = float(np.clip(y.mean() if n else 0.5, 0.01, 0.99))
    base, inner = float(np.log(p0 / (1 - p0))), 2**depth - 1
    feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if n == 0 or y.min() == y.max():
        return Forest(base, feature[:0], cut[:0], value[:0])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    score = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node, low, high = np.zeros(n, np.int64), {0: -np.inf}, {0: np.inf}
        for i in range(inner):
            rows = np.flatnonzero(node == i)
            lo, hi, best = low[i], high[i], (1e-6, None)
            weight = lambda a, b: np.clip(a / (b + ridge), lo, hi)  # noqa: B023, E731
            gain = lambda w, a, b: a * w - 0.5 * (b + ridge) * w * w
            if len(rows) >= 2 * least:
                gi, hi_ = g[rows], h[rows]
                whole = gain(weight(gi.sum(), hi_.sum()), gi.sum(), hi_.sum())
                for j in range(m):
                    k = len(edges[j])
                    if not k:
                        continue
                    c = code[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(c, weights=v, minlength=k + 1))[:-1] for v in (gi, hi_, np.ones(len(rows))))
                    gr, hr = gi.sum() - gl, hi_.sum() - hl
                    wl, wr = weight(gl, hl), weight(gr, hr)
                    won = gain(wl, gl, hl) + gain(wr, gr, hr) - whole
                    won[(nl < least) | (len(rows) - nl < least) | (signs[j] * (wr - wl) < 0)] = -np.inf
                    if won[b := int(np.argmax(won))] > best[0]:
                        best = (won[b], (j, b, wl[b], wr[b]))
            left, right = 2 * i + 1, 2 * i + 2
            low[left], high[left], low[right], high[right] = lo, hi, lo, hi
            if best[1]:
                j, b, wl, wr = best[1]
                feature[t, i], cut[t, i] = j, edges[j][b]
                if signs[j]:
                    mid = (wl + wr) / 2
                    upper, lower = (right, left) if signs[j] > 0 else (left, right)
                    low[upper], high[lower] = mid, mid
            node[rows] = np.where(x[rows, feature[t, i]] > cut[t, i], right, left)
        for leaf in range(inner + 1):
            rows = np.flatnonzero(node == inner + leaf)
            value[t, leaf] = rate * float(np.clip(g[rows].sum() / (h[rows].sum() + ridge), low[inner + leaf], high[inner + leaf]))
        score += value[t, node - inner]
    return Forest(base, feature, cut, value)
