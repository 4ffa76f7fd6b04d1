"""Decision trees on warping deviations, and position weights learned from must- and cannot-link labels."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from tempora.kernels.dtw import Sweep, warped
from tempora.settings import DistanceSettings


def entropy(targets: np.ndarray) -> float:
    _, n = np.unique(targets, return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log(p)).sum())


def k_distance(values: np.ndarray, threshold: float, k: int) -> float:
    """Distance from a threshold to its k-th nearest value."""
    return float(np.sort(np.abs(values - threshold))[min(k, len(values)) - 1])


def best_split(values: np.ndarray, targets: np.ndarray) -> tuple[float, float]:
    """(information gain, threshold): halfway between sorted distinct values."""
    order = np.argsort(values, kind="stable")
    v, t = values[order], targets[order]
    whole, best = entropy(t), (0.0, math.nan)
    for cut in np.flatnonzero(np.diff(v) > 0) + 1:
        gain = whole - cut / len(v) * entropy(t[:cut]) - (1 - cut / len(v)) * entropy(t[cut:])
        if gain > best[0] + 1e-12:
            best = float(gain), float((v[cut - 1] + v[cut]) / 2)
    return best


@dataclass
class Tree:
    """Nodes as parallel lists; feature -1 is a leaf."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    samples: list[int] = field(default_factory=list)
    impurity: list[float] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, targets: np.ndarray) -> int:
        for column, x in ((self.feature, -1), (self.threshold, math.nan), (self.left, -1), (self.right, -1), (self.samples, len(targets)), (self.impurity, entropy(targets)), (self.value, float(targets.mean()))):
            column.append(x)
        return len(self.feature) - 1

    @property
    def used(self) -> set[int]:
        return {f for f in self.feature if f >= 0}

    @property
    def depth(self) -> int:
        def below(n: int) -> int:
            return 0 if self.feature[n] < 0 else 1 + max(below(self.left[n]), below(self.right[n]))

        return below(0) if self.feature else 0

    def leaf_entropy(self) -> float:
        """Mean entropy of the leaves, by samples."""
        leaves = [(n, e) for n, e, f in zip(self.samples, self.impurity, self.feature, strict=True) if f < 0]
        return sum(n * e for n, e in leaves) / max(1, sum(n for n, _ in leaves))


def fit(features: np.ndarray, targets: np.ndarray, use_once: bool = True, ignore: Sequence[int] = (), least_gain: float = 0.0, max_kd: float | None = None) -> Tree:
    """Grows a tree by gain * (1 + k-distance / largest k-distance), k = 0.5 % of the rows: wide gaps are preferred."""
    features, targets = np.asarray(features, float), np.asarray(targets)
    tree, banned, k = Tree(), set(ignore), max(1, math.ceil(0.005 * len(targets)))
    open_ = [(tree.add(targets), np.arange(len(targets)))]
    while open_:
        node, rows = open_.pop(0)
        if len(np.unique(targets[rows])) < 2:
            continue
        found = []
        for f in range(features.shape[1]):
            if f in banned:
                continue
            gain, threshold = best_split(features[rows, f], targets[rows])
            if gain > least_gain and not math.isnan(threshold):
                found.append((gain, k_distance(features[rows, f], threshold, k), f, threshold))
        if not found:
            continue
        widest = max_kd or max(kd for _, kd, _, _ in found) or 1.0
        _, f, threshold = max(((g * (1 + kd / widest)), -f, t) for g, kd, f, t in found)
        f = -f
        if use_once:
            banned.add(f)
        low = features[rows, f] <= threshold
        tree.feature[node], tree.threshold[node] = f, threshold
        tree.left[node], tree.right[node] = tree.add(targets[rows[low]]), tree.add(targets[rows[~low]])
        open_ += [(tree.left[node], rows[low]), (tree.right[node], rows[~low])]
    return tree


def deviations(prototype: np.ndarray, values: Sequence[np.ndarray], window: int | None = None) -> np.ndarray:
    """Rows of features: for each point of the prototype, the mean negative and the mean positive deviation along the path."""
    out = np.zeros((len(values), 2 * len(prototype)))
    _, paths = warped([prototype] * len(values), values, DistanceSettings(window=window))
    for row, v, path in zip(out, values, paths, strict=True):
        d = prototype[path[:, 0]] - np.asarray(v)[path[:, 1]]
        for side, part in ((0, d < 0), (1, d > 0)):
            n = np.bincount(path[part, 0], minlength=len(prototype))
            total = np.bincount(path[part, 0], np.abs(d[part]), len(prototype))
            row[side::2] = np.where(n > 0, total / np.maximum(n, 1), 0)
    return out


def knots(must: Sequence[float], cannot: Sequence[float], strict: bool = True) -> tuple[float, float, float, float]:
    """Four knots for one side of one position, from deviations of linked and of separated series."""
    must, cannot = sorted(must), sorted(cannot)
    below = [m for m in must if not cannot or m <= max(cannot)]
    most = below[-1] if below else 0.0
    above = [c for c in cannot if not must or c >= must[-1]]
    v3 = above[0] if above else (cannot[-1] if cannot and strict else math.inf)
    v1 = min(1.5 * most, v3)
    v0, v2 = 0.5 * v1, 0.9 * v3
    if v2 < v1:
        v1 = v2 = (v1 + v2) / 2
    return v0, v1, v2, v3


def learned_weights(prototype: Sequence[float], values: Sequence[Sequence[float]], labels: Sequence[int], window: int | None = None, rounds: int = 10, least_purity: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(knots: points x 8, importance: points x 2) from series labelled 1 (must link) or 0 (cannot link).

    Trees are learned again and again without the features used before, each round counting
    for 0.66 of the one before. Only positions that a tree splits on get knots; elsewhere
    differences count as they are.
    """
    prototype = np.asarray(prototype, float)
    return weights_from(deviations(prototype, [np.asarray(v, float) for v in values], window), np.asarray(labels), rounds, least_purity)


def weights_from(rows: np.ndarray, labels: np.ndarray, rounds: int = 10, least_purity: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """As learned_weights, from rows of deviations. The prototype itself is a row of zeros that must link."""
    points = rows.shape[1] // 2
    features = np.concatenate([np.zeros((1, 2 * points)), rows])
    targets = np.concatenate([[0], 1 - labels])
    out = np.tile([math.inf, math.inf, 0.0, 0.0, 0.0, 0.0, math.inf, math.inf], (points, 1))
    importance, used, weight = np.zeros((points, 2)), set(), 1.0
    for _ in range(rounds):
        tree = fit(features, targets, ignore=sorted(used))
        if not tree.used or 1 - tree.leaf_entropy() < least_purity:
            break
        for f in tree.used:
            at, side = divmod(f, 2)
            v = knots(features[1:][labels == 1, f].tolist(), features[1:][labels == 0, f].tolist())
            out[at, slice(3, None, -1) if side == 0 else slice(4, 8)] = v
            importance[at, side] += weight
        used |= tree.used
        weight *= 0.66
    return out, importance


def twin_table(first: Sequence, second: Sequence, other_first: Sequence, other_second: Sequence, settings: DistanceSettings = DistanceSettings()) -> tuple[np.ndarray, np.ndarray]:
    """Two cost tables: the first pair's, and the second pair's costs accumulated along the first's choices."""
    table = Sweep([first], [second], settings, keep=True).table[:, :, 0]
    a, b = np.asarray(other_first, float), np.asarray(other_second, float)
    penalty, twin = settings.to_cost(settings.penalty), np.full_like(table, np.inf)
    twin[0, 0] = 0
    for i in range(1, len(table)):
        for j in range(1, table.shape[1]):
            if np.isfinite(table[i, j]):
                options = ((table[i - 1, j - 1], i - 1, j - 1), (table[i - 1, j] + penalty, i - 1, j), (table[i, j - 1] + penalty, i, j - 1))
                _, p, q = min(options, key=lambda o: o[0])
                twin[i, j] = settings.to_cost(abs(a[i - 1] - b[j - 1])) + twin[p, q]
    return table, twin
