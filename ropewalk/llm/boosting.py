"""Gradient-boosted trees with a softmax over classes, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """``feature[t, n]`` and ``cut[t, n]`` of the inner nodes (heap order) and ``value[t, leaf]``; tree t adds to class
    t modulo the classes."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    prior: np.ndarray

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def log_chances(self, x: np.ndarray) -> np.ndarray:
        """(rows, classes): log of the softmax."""
        codes, rows = self.binned(x), np.arange(len(x))
        scores = np.tile(self.prior, (len(x), 1))
        inner = self.feature.shape[1]
        for t, (feature, cut, value) in enumerate(zip(self.feature, self.cut, self.value)):
            at = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                at = 2 * at + 1 + (codes[rows, feature[at]] > cut[at])
            scores[:, t % len(self.prior)] += value[at - inner]
        return scores - np.logaddexp.reduce(scores, axis=1, keepdims=True)


def _grow(codes: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree on gradients and curvatures: level by level, the best cut of all features by histograms."""
    n, features = codes.shape
    feature, cut = np.zeros(2 ** depth - 1, np.int64), np.full(2 ** depth - 1, BINS, np.int64)
    at, cell = np.zeros(n, np.int64), codes + np.arange(features) * BINS
    wide = [np.repeat(v, features) for v in (g, h)]
    for level in range(depth):
        nodes = 2 ** level
        flat = (cell + (at * features * BINS)[:, None]).ravel()
        sums = [np.bincount(flat, v, nodes * features * BINS).reshape(nodes, features, BINS).cumsum(2) for v in wide]
        (gl, hl), (gt, ht) = sums, [s[:, :1, -1:] for s in sums]
        gain = gl ** 2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt ** 2 / (ht + ridge)
        gain[(hl < 1) | (ht - hl < 1)] = 0
        gain = gain[:, :, :-1].reshape(nodes, -1)
        best = gain.argmax(1)
        use = gain[np.arange(nodes), best] > 1e-9
        first = nodes - 1
        feature[first:first + nodes] = np.where(use, best // (BINS - 1), 0)
        cut[first:first + nodes] = np.where(use, best % (BINS - 1), BINS)
        at = 2 * at + (codes[np.arange(n), feature[first + at]] > cut[first + at])
    leaves = 2 ** depth
    return feature, cut, -np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)


def fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 40, depth: int = 4, rate: float = 0.25,
        ridge: float = 2.0, share: float = 0.6, seed: int = 0) -> Trees:
    """Boosted trees for labels ``y``; each tree sees ``share`` of the rows, drawn by ``seed``."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    prior = np.log(np.maximum(np.bincount(y, minlength=classes), 1) / len(y))
    model = Trees(edges, np.zeros((0, 2 ** depth - 1), int), np.zeros(0), np.zeros(0), prior)
    codes = model.binned(x)
    scores, grown, hot = np.tile(prior, (len(x), 1)), [], np.eye(classes)[y]
    for _ in range(rounds):
        p = np.exp(scores - np.logaddexp.reduce(scores, axis=1, keepdims=True))
        for c in range(classes):
            rows = np.flatnonzero(rng.random(len(x)) < share)
            pc = p[rows, c]
            feature, cut, value = _grow(codes[rows], pc - hot[rows, c], np.maximum(pc * (1 - pc), 1e-6), depth, ridge)
            grown.append((feature, cut, rate * value))
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (codes[np.arange(len(x)), feature[at]] > cut[at])
            scores[:, c] += rate * value[at - (2 ** depth - 1)]
    model.feature, model.cut, model.value = (np.array([t[j] for t in grown]) for j in range(3))
    return model
