"""Gradient-boosted regression trees for a yes-or-no label, on binned features: a small trainer for small models."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    cuts: list[np.ndarray]  # for each feature
    feature: np.ndarray  # tree x inner node, heap order
    cut: np.ndarray
    leaf: np.ndarray  # tree x leaf
    bias: float


def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.int64)


def train(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 16, ridge: float = 1.0, share: float = 0.35, seed: int = 42) -> Trees:
    """Second-order boosting of the logistic loss; every split is the best of all features and cuts, over a share of the
    rows that each tree draws anew."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    b, n_feat = _bins(x, cuts), x.shape[1]
    wide = max(len(c) for c in cuts) + 1
    flat = b + np.arange(n_feat) * wide
    bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score = np.full(len(y), bias)
    feature, cut, leaf, rng = [], [], [], np.random.default_rng(seed)
    for _ in range(rounds):
        own = rng.random(len(y)) < share
        p = 1 / (1 + np.exp(-score[own]))
        g, h = p - y[own], p * (1 - p)
        rows, flat_own = b[own], flat[own]
        each, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        f_of, c_of = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, wide, np.int64)
        for level in range(depth):
            base = 2**level - 1
            key = ((node - base)[:, None] * n_feat * wide + flat_own).ravel()
            G, H = (np.bincount(key, np.repeat(v, n_feat), 2**level * n_feat * wide).reshape(2**level, n_feat, wide).cumsum(axis=2) for v in (g, h))
            tg, th = G[:, :, -1:], H[:, :, -1:]
            gain = G**2 / (H + ridge) + (tg - G) ** 2 / (th - H + ridge) - tg**2 / (th + ridge)
            best = gain.reshape(2**level, -1).argmax(axis=1)
            f_of[base : base + 2**level], c_of[base : base + 2**level] = best // wide, best % wide
            node = 2 * node + 1 + (rows[each, f_of[node]] > c_of[node])
        at = node - (2**depth - 1)
        value = -rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
        node = np.zeros(len(y), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (b[np.arange(len(y)), f_of[node]] > c_of[node])
        score += value[node - (2**depth - 1)]
        feature.append(f_of), cut.append(c_of), leaf.append(value)
    return Trees(cuts, np.array(feature), np.array(cut), np.array(leaf), bias)


def predict(model: Trees, x: np.ndarray) -> np.ndarray:
    """The log-odds of each row."""
    b, rows = _bins(x, model.cuts), np.arange(len(x))
    score = np.full(len(x), model.bias)
    inner = model.feature.shape[1]
    for f, c, leaf in zip(model.feature, model.cut, model.leaf):
        node = np.zeros(len(x), np.int64)
        while len(node) and node[0] < inner:
            node = 2 * node + 1 + (b[rows, f[node]] > c[node])
        score += leaf[node - inner]
    return score
