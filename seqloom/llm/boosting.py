"""Gradient-boosted trees for two classes: histogram splits, second-order gains, logistic loss, Platt calibration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth, as arrays (tree, node): feature, cut (go right if x > cut), and leaf values."""

    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        inner = self.features.shape[1]
        for f, c, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -40, 40)))


UNIT = 1 << 24  # of a gradient: sums of whole numbers do not depend on their order, so tasks can share them out
BINS = 32


def quantiles(bins: int = BINS) -> np.ndarray:
    return np.linspace(0, 1, bins + 1)[1:-1]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1).astype(np.uint8)


def gradients(x: np.ndarray, y: np.ndarray, done: Trees, features: np.ndarray, cuts: np.ndarray, level: int, bins: int = BINS) -> np.ndarray:
    """Sums of first and second gradients, in UNIT, of binned rows by node of a level, feature and bin.

    ``features`` and ``cuts`` are those of the tree that grows, down to that level.
    """
    p = 1 / (1 + np.exp(-done.margin(x)))
    both = np.rint((p - y) * UNIT), np.rint(np.maximum(p * (1 - p), 1e-6) * UNIT)
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(level):
        node = 2 * node + 1 + (x[rows, features[node]] > cuts[node])
    at = (node - (2**level - 1)) * bins
    size = 2**level * bins
    out = [np.stack([np.bincount(at + x[:, j], w, size) for j in range(x.shape[1])]).reshape(-1, 2**level, bins) for w in both]
    return np.stack(out, -1).astype(np.int64)


def grow(sums: Callable[[Trees, np.ndarray, np.ndarray, int], np.ndarray], edges: list[np.ndarray], rounds: int = 40, depth: int = 3, rate: float = 0.3, l2: float = 1.0) -> Trees:
    """Trees over bins, from what ``sums`` gives of all rows: ``gradients`` of a level, one level of a tree at a time."""
    inner = 2**depth - 1
    features, cuts, leaves = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, inner + 1))
    for r in range(rounds):
        done = Trees(features[:r], cuts[:r], leaves[:r])
        for level in range(depth):
            found = sums(done, features[r], cuts[r], level) / UNIT
            for k in range(2**level):
                at, best = 2**level - 1 + k, 1e-9
                run = found[:, k].cumsum(1)
                whole = run[0, -1]
                sides = whole, np.zeros(2)  # without a cut all go left
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    (gl, hl), (gs, hs) = run[j, : len(e)].T, whole
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    c = int(gain.argmax())
                    if gain[c] > best:
                        best, features[r, at], cuts[r, at] = gain[c], j, c
                        sides = run[j, c], whole - run[j, c]
                if level == depth - 1:
                    leaves[r, 2 * k : 2 * k + 2] = [-rate * g / (h + l2) for g, h in sides]
    return Trees(features, cuts, leaves)


def unbinned(trees: Trees, edges: list[np.ndarray]) -> Trees:
    """The same trees over values."""
    cuts = [[edges[f][int(c)] if np.isfinite(c) else c for f, c in zip(fs, cs, strict=True)] for fs, cs in zip(trees.features, trees.cuts, strict=True)]
    return replace(trees, cuts=np.array(cuts))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = BINS, l2: float = 1.0, held: np.ndarray | None = None) -> Trees:
    """Trees on rows ``x`` with classes ``y`` in {0, 1}; the rows ``held``, else every fifth, are kept for the calibration."""
    held = np.arange(len(x)) % 5 == 4 if held is None else held
    a, t = x[~held], y[~held].astype(float)
    edges = [np.unique(np.quantile(a[:, j], quantiles(bins))) if len(a) else np.zeros(0) for j in range(x.shape[1])]
    own = binned(a, edges)
    trees = unbinned(grow(lambda *state: gradients(own, t, *state, bins), edges, rounds, depth, rate, l2), edges)
    if held.any() and 0 < y[held].sum() < held.sum():
        trees.slope, trees.shift = platt(trees.margin(x[held]), y[held].astype(float))
    return trees


def platt(m: np.ndarray, y: np.ndarray, steps: int = 50, times: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of a logistic fit to margins, by Newton's method on smoothed classes. A row counts as often as ``times`` says."""
    times = np.ones(len(m)) if times is None else times
    n1, n0 = (times * y).sum(), (times * (1 - y)).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.array([1.0, 0.0])
    z = np.stack([m, np.ones_like(m)], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (times * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (times * (p - t)) + 1e-3 * (w - [1.0, 0.0]))
        w = w - step
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def threshold(p: np.ndarray, y: np.ndarray, precision: float, times: np.ndarray | None = None) -> float:
    """The least cut at which the rows above it have the wanted precision; over 1 if none has. ``y`` may be a share of ``times`` rows."""
    order = np.argsort(-p, kind="stable")
    times = (np.ones(len(y)) if times is None else times)[order]
    hits = np.cumsum(y[order] * times) / np.cumsum(times)
    good = np.flatnonzero(hits >= precision)
    return float(p[order[good[-1]]]) if len(good) else 1.1
