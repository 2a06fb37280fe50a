"""Gradient-boosted trees for two classes on dense features, with isotonic calibration; numpy, on bounded samples on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Node i sends a row left if its feature is at most its threshold; feature -1 marks a leaf."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right, value = np.array(self.left), np.array(self.right), np.array(self.value)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return value[at]
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] <= threshold[node], left[node], right[node])


@dataclass
class Boosted:
    base: float
    trees: list[Tree]
    #: Calibration: probability at each raw score, by linear interpolation.
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.predict(x)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def _grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int, ridge: float, rate: float) -> Tree:
    tree = Tree([], [], [], [], [])

    def node(rows: np.ndarray, level: int) -> int:
        i = len(tree.feature)
        g, h = grad[rows].sum(), hess[rows].sum()
        for part, v in ((tree.feature, -1), (tree.threshold, 0.0), (tree.left, -1), (tree.right, -1), (tree.value, float(-rate * g / (h + ridge)))):
            part.append(v)
        if level == depth or len(rows) < 2 * least:
            return i
        best = (1e-6, -1, -1)
        for f, cuts in enumerate(edges):
            if not len(cuts):
                continue
            b = bins[rows, f]
            n = np.bincount(b, minlength=len(cuts) + 1)
            gs, hs, ns = np.cumsum(np.bincount(b, grad[rows], len(cuts) + 1))[:-1], np.cumsum(np.bincount(b, hess[rows], len(cuts) + 1))[:-1], np.cumsum(n)[:-1]
            gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            if gain.max() > best[0]:
                best = (float(gain.max()), f, int(gain.argmax()))
        if best[1] < 0:
            return i
        goes = bins[rows, best[1]] <= best[2]
        tree.feature[i], tree.threshold[i] = best[1], float(edges[best[1]][best[2]])
        tree.left[i] = node(rows[goes], level + 1)
        tree.right[i] = node(rows[~goes], level + 1)
        return i

    node(np.arange(len(x)), 0)
    return tree


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing levels that fit label best. Levels are drawn towards the mean as by one row of each class."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # sum, count, lowest score, highest score
    for s, y in zip(score[order].tolist(), label[order].tolist()):
        if pools and pools[-1][3] == s:
            pools[-1][0] += y
            pools[-1][1] += 1
        else:
            pools.append([y, 1, s, s])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            a = pools.pop()
            pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], pools[-1][2], a[3]]
    mean = float(label.mean())
    knots, levels = [], []
    for total, n, low, high in pools:
        p = (total + mean) / (n + 1)
        knots += [low, high] if high > low else [low]
        levels += [p, p] if high > low else [p]
    return np.array(knots), np.maximum.accumulate(np.array(levels))


def fit(x: np.ndarray, y: np.ndarray, x_cal: np.ndarray, y_cal: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, least: int = 5, ridge: float = 1.0, most_bins: int = 48) -> Boosted:
    """Fit on (x, y) and calibrate on (x_cal, y_cal); too few rows of a class give the constant observed share."""
    if not len(y) or y.min() == y.max():
        share = float(np.concatenate([y, y_cal]).mean()) if len(y) + len(y_cal) else 0.0
        return Boosted(0.0, [], np.array([0.0]), np.array([share]))
    edges = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        if len(values) > most_bins:
            values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, most_bins + 1)))
        edges.append((values[:-1] + values[1:]) / 2)
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    share = float(y.mean())
    model = Boosted(float(np.log(share / (1 - share))), [], np.array([0.0]), np.array([0.0]))
    raw = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        tree = _grow(x, bins, edges, p - y, p * (1 - p), depth, least, ridge, rate)
        if len(tree.feature) == 1:
            break
        model.trees.append(tree)
        raw += tree.predict(x)
    if len(y_cal) and y_cal.min() != y_cal.max():
        model.knots, model.levels = isotonic(model.raw(x_cal), y_cal.astype(float))
    else:
        model.knots = np.linspace(-6, 6, 49)
        model.levels = 1 / (1 + np.exp(-model.knots))
    return model
