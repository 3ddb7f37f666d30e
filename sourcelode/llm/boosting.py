"""Small boosted models in numpy: binning, trees, an additive model and isotonic calibration.

They are fitted on the driver, on a bounded sample of labelled rows, and are
plain arrays of bounded size afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Bins:
    """Quantile bins of every feature."""

    def __init__(self, x: np.ndarray, most: int = 64):
        grid = np.linspace(0, 1, most + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], grid)) for f in range(x.shape[1])]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1)


def _gain(g, h, l2):
    return g * g / (h + l2)


class BoostedTrees:
    """Gradient-boosted trees of fixed depth for a 0/1 target; rows of equal bins score alike."""

    def __init__(self, x, y, trees=120, depth=3, rate=0.15, l2=4.0, least=8, most_bins=64):
        self.bins, self.depth = Bins(x, most_bins), depth
        b, n_f, width = self.bins(x), x.shape[1], most_bins
        flat = b + np.arange(n_f) * width
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.start)
        inner, leaves = (1 << depth) - 1, 1 << depth
        self.feature, self.cut = np.zeros((trees, inner), np.int64), np.full((trees, inner), width, np.int64)
        self.value = np.zeros((trees, leaves))
        for t in range(trees):
            mu = sigmoid(score)
            g, h = y - mu, mu * (1 - mu)
            at = np.zeros(len(y), np.int64)
            for level in range(depth):
                nodes = 1 << level
                index = (at[:, None] * (n_f * width) + flat).ravel()
                tables = [np.bincount(index, np.repeat(v, n_f), nodes * n_f * width).reshape(nodes, n_f, width) for v in (g, h, np.ones(len(y)))]
                gl, hl, nl = (v.cumsum(axis=2)[:, :, :-1] for v in tables)
                gt, ht, nt = (v.sum(axis=2, keepdims=True) for v in tables)
                gain = _gain(gl, hl, l2) + _gain(gt - gl, ht - hl, l2) - _gain(gt, ht, l2)
                gain[(nl < least) | (nt - nl < least)] = 0
                best = gain.reshape(nodes, -1).argmax(axis=1)
                f, c = best // (width - 1), best % (width - 1) + 1
                c[gain.reshape(nodes, -1).max(axis=1) <= 1e-9] = width  # everything goes left
                self.feature[t, nodes - 1 : 2 * nodes - 1], self.cut[t, nodes - 1 : 2 * nodes - 1] = f, c
                at = 2 * at + (b[np.arange(len(y)), f[at]] >= c[at])
            gs, hs = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
            self.value[t] = rate * gs / (hs + l2)
            score = score + self.value[t][at]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of rows of features."""
        b, out = self.bins(x), np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = (1 << level) - 1 + at
                at = 2 * at + (b[rows, feature[node]] >= cut[node])
            out += value[at]
        return out


@dataclass
class Isotonic:
    """Non-decreasing step means of y over the score, joined by straight lines."""

    at: np.ndarray
    value: np.ndarray

    @classmethod
    def fit(cls, score, y, weight_of_half: float = 1.0) -> Isotonic:
        xs, back = np.unique(score, return_inverse=True)
        total, n = np.bincount(back, y), np.bincount(back).astype(float)
        blocks: list[list[float]] = []
        for i in range(len(xs)):
            blocks.append([total[i], n[i], i])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                s, m, _ = blocks.pop()
                blocks[-1][0] += s
                blocks[-1][1] += m
        # a half observation of each class keeps the ends off 0 and 1
        at = [float(np.average(xs[int(b[2]) : int(nxt)], weights=n[int(b[2]) : int(nxt)])) for b, nxt in zip(blocks, [b[2] for b in blocks[1:]] + [len(xs)])]
        return cls(np.array(at), np.array([(b[0] + 0.5 * weight_of_half) / (b[1] + weight_of_half) for b in blocks]))

    def __call__(self, score):
        return np.interp(score, self.at, np.maximum.accumulate(self.value))


class AdditiveModel:
    """Generalised additive model with pairwise terms, boosted cyclically.

    One round visits every feature in turn and adds a shallow tree on that
    feature alone to its lookup table; afterwards the strongest pairs get
    tables of their own in the same way. A score is a sum of table entries.
    """

    def __init__(self, x, y, rounds=60, pair_rounds=30, pairs=6, rate=0.15, l2=4.0, most_bins=32, pair_bins=8):
        self.bins, self.coarse = Bins(x, most_bins), Bins(x, pair_bins)
        b, c, n_f = self.bins(x), self.coarse(x), x.shape[1]
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(p / (1 - p)))
        self.tables, score = np.zeros((n_f, most_bins)), np.full(len(y), self.start)

        def slopes():
            mu = sigmoid(score)
            return y - mu, mu * (1 - mu)

        for _ in range(rounds):
            for f in range(n_f):
                g, h = slopes()
                step = rate * _shallow(np.bincount(b[:, f], g, most_bins), np.bincount(b[:, f], h, most_bins), l2)
                self.tables[f] += step
                score += step[b[:, f]]
        g, h = slopes()
        cells = {(i, j): c[:, i] * pair_bins + c[:, j] for i, j in combinations(range(n_f), 2)}
        strength = {k: _gain(np.bincount(v, g, pair_bins**2), np.bincount(v, h, pair_bins**2), l2).sum() for k, v in cells.items()}
        self.pairs = sorted(strength, key=lambda k: (-strength[k], k))[:pairs]
        self.pair_tables = np.zeros((len(self.pairs), pair_bins**2))
        for _ in range(pair_rounds):
            for k, pair in enumerate(self.pairs):
                g, h = slopes()
                at = cells[pair]
                gs, hs = (np.bincount(at, v, pair_bins**2).reshape(pair_bins, pair_bins) for v in (g, h))
                step = rate * _crossed(gs, hs, l2).ravel()
                self.pair_tables[k] += step
                score += step[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds, by adding up the entries of the bins."""
        b, c = self.bins(x), self.coarse(x)
        out = self.start + self.tables[np.arange(b.shape[1]), b].sum(axis=1)
        side = round(self.pair_tables.shape[1] ** 0.5) if len(self.pairs) else 0
        for (i, j), t in zip(self.pairs, self.pair_tables):
            out += t[c[:, i] * side + c[:, j]]
        return out


def _split(g, h, l2):
    """Best cut of a run of bins: (gain, cut)."""
    gl, hl = g.cumsum()[:-1], h.cumsum()[:-1]
    if not len(gl):
        return 0.0, 0
    gain = _gain(gl, hl, l2) + _gain(g.sum() - gl, h.sum() - hl, l2) - _gain(g.sum(), h.sum(), l2)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _shallow(g, h, l2):
    """Values per bin of a tree with at most four leaves on one feature."""
    runs = [(0, len(g))]
    for _ in range(3):
        gain, cut, k = max((*_split(g[a:b], h[a:b], l2), k) for k, (a, b) in enumerate(runs))
        if gain <= 1e-9:
            break
        a, b = runs[k]
        runs[k : k + 1] = [(a, a + cut), (a + cut, b)]
    out = np.empty(len(g))
    for a, b in runs:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def _crossed(g, h, l2):
    """Values per cell of a tree that cuts one feature and then the other on either side."""
    best = None
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        _, cut = _split(gg.sum(axis=1), hh.sum(axis=1), l2)
        total, out = 0.0, np.empty(gg.shape)
        for rows in (slice(0, cut), slice(cut, None)):
            gs, hs = gg[rows].sum(axis=0), hh[rows].sum(axis=0)
            _, k = _split(gs, hs, l2)
            for cols in (slice(0, k), slice(k, None)):
                a, b = gs[cols].sum(), hs[cols].sum()
                out[rows, cols] = a / (b + l2)
                total += _gain(a, b, l2)
        if best is None or total > best[0]:
            best = total, out.T if turn else out
    return best[1]
