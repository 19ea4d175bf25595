"""Boosted trees and isotonic calibration in numpy, for bounded samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth, as arrays over (tree, inner node) and (tree, leaf)."""

    base: float
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 3,
              rate: float = 0.2, bins: int = 64, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss over binned features."""
    rows, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], axis=1)
    share = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    margin = np.full(rows, base)
    inner = (1 << depth) - 1
    features, cuts, leaves = [], [], []
    for _ in range(rounds):
        p = _sigmoid(margin)
        gradient, hessian = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(rows, dtype=np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            place = node - first
            best = np.zeros(count)
            for j in range(width):
                size = len(edges[j]) + 1
                if size == 1:
                    continue
                key = place * size + binned[:, j]
                g = np.bincount(key, gradient, count * size).reshape(count, size).cumsum(axis=1)
                h = np.bincount(key, hessian, count * size).reshape(count, size).cumsum(axis=1)
                left, right = g[:, :-1], g[:, -1:] - g[:, :-1]
                gain = (left ** 2 / (h[:, :-1] + ridge) + right ** 2 / (h[:, -1:] - h[:, :-1] + ridge)
                        - g[:, -1:] ** 2 / (h[:, -1:] + ridge))
                at = gain.argmax(axis=1)
                top = gain[np.arange(count), at]
                better = top > best + 1e-9
                best = np.where(better, top, best)
                feature[first:first + count][better] = j
                cut[first:first + count][better] = edges[j][at[better]]
            node = 2 * node + 1 + (x[np.arange(rows), feature[node]] > cut[node])
        place = node - inner
        g = np.bincount(place, gradient, inner + 1)
        h = np.bincount(place, hessian, inner + 1)
        leaf = rate * g / (h + ridge)
        margin = margin + leaf[place]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    shape = (rounds, -1)
    return Trees(base, depth, np.array(features).reshape(shape), np.array(cuts).reshape(shape),
                 np.array(leaves).reshape(shape))


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit: pooled adjacent violators.

    Each pooled block is a knot at its first and its last score; values between
    blocks are interpolated.
    """
    order = np.argsort(score, kind="stable")
    score, y, weight = score[order], y[order], weight[order]
    unique, start = np.unique(score, return_index=True)
    total = np.add.reduceat(weight, start)
    mean = np.add.reduceat(weight * y, start) / total
    blocks: list[list[float]] = []
    for s, m, w in zip(unique, mean, total):
        blocks.append([m, w, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, high = blocks.pop()
            m1, w1, low, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, low, high])
    knots = [(k, b[0]) for b in blocks for k in dict.fromkeys((b[2], b[3]))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


@dataclass
class Calibrated:
    """Trees whose raw score is turned into a probability by isotonic knots."""

    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.values[0])
        return np.interp(self.trees.raw(x), self.knots, self.values)


def fit_calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, folds: int = 5, **options) -> Calibrated:
    """Trees on all rows; the calibration is fitted on out-of-fold scores."""
    weight = weight / weight.mean() if len(weight) else weight
    if len(y) < 2 * folds or y.min() == y.max():
        share = float(np.average(y, weights=weight)) if len(y) else 0.0
        return Calibrated(None, np.zeros(1), np.array([share]))
    fold = np.empty(len(y), dtype=np.int64)
    for label in (0, 1):  # every fold gets its share of both labels
        own = np.nonzero(y == label)[0]
        fold[own] = np.arange(len(own)) % folds
    raw = np.zeros(len(y))
    for k in range(folds):
        out = fold == k
        raw[out] = fit_trees(x[~out], y[~out], weight[~out], **options).raw(x[out])
    knots, values = isotonic(raw, y, weight)
    return Calibrated(fit_trees(x, y, weight, **options), knots, values)
