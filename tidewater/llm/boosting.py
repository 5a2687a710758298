"""Gradient-boosted trees for few classes: Newton steps on the softmax loss, splits from histograms, complete trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """feature and threshold by tree and inner node (breadth first), value by tree and leaf; tree t adds to class t % classes."""

    start: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        """Log chances of the classes, by row."""
        classes, trees = len(self.start), len(self.feature)
        depth = int(np.log2(self.value.shape[1]))
        out = np.empty((len(x), classes))
        at_tree = np.arange(trees)
        for k in range(0, len(x), rows):
            own = x[k : k + rows]
            node = np.zeros((len(own), trees), np.intp)
            line = np.arange(len(own))[:, None]
            for _ in range(depth):
                right = own[line, self.feature[at_tree, node]] > self.threshold[at_tree, node]
                node = 2 * node + 1 + right
            got = self.value[at_tree, node - (2**depth - 1)]
            out[k : k + rows] = self.start + got.reshape(len(own), -1, classes).sum(1)
        top = out.max(1, keepdims=True)
        return out - top - np.log(np.exp(out - top).sum(1, keepdims=True))


def fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int, depth: int, rate: float = 0.25, bins: int = 32, smooth: float = 2.0, least: float = 2.0) -> Trees:
    """smooth: added to the sum of curvatures of a leaf; least: the least such sum of a child."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)], 1)
    flat = binned + np.arange(width) * bins
    start = np.log(np.maximum(np.bincount(y, minlength=classes), 1) / n)
    score = np.tile(start, (n, 1))
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        chance = np.exp(score - score.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        for c in range(classes):
            slope, curve = chance[:, c] - (y == c), np.maximum(chance[:, c] * (1 - chance[:, c]), 1e-6)
            feature, threshold = np.zeros(2**depth - 1, np.intp), np.full(2**depth - 1, np.inf)
            node = np.zeros(n, np.intp)
            for level in range(depth):
                count, first = 2**level, 2**level - 1
                own = node - first
                at = (own[:, None] * (width * bins) + flat).ravel()
                sums = [np.bincount(at, np.repeat(v, width), count * width * bins).reshape(count, width, bins) for v in (slope, curve)]
                left_g, left_h = (np.cumsum(s, 2) for s in sums)
                all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
                right_g, right_h = all_g - left_g, all_h - left_h
                gain = left_g**2 / (left_h + smooth) + right_g**2 / (right_h + smooth) - all_g**2 / (all_h + smooth)
                gain[(left_h < least) | (right_h < least)] = 0
                best = gain.reshape(count, -1).argmax(1)
                f, b = best // bins, best % bins
                for k in range(count):
                    # a node without a gain sends all rows to the left
                    if gain[k, f[k], b[k]] > 1e-9 and b[k] < len(cuts[f[k]]):
                        feature[first + k], threshold[first + k] = f[k], cuts[f[k]][b[k]]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
            leaf = node - (2**depth - 1)
            value = -rate * np.bincount(leaf, slope, 2**depth) / (np.bincount(leaf, curve, 2**depth) + smooth)
            score[:, c] += value[leaf]
            features.append(feature)
            thresholds.append(threshold)
            values.append(value)
    return Trees(start, np.array(features), np.array(thresholds), np.array(values))
