"""An adaptive random forest that learns one row at a time: Hoeffding trees, Poisson bagging, drift resets."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

import numpy as np

#: Confidence of the detectors of a tree's warnings and drifts.
WARNING, DRIFT = 0.01, 0.001
#: Where between the ends of a feature's range a split may be.
CUTS = np.linspace(0.1, 0.9, 9).tolist()


class Adwin:
    """Adaptive window over values in [0, 1]: it drops old buckets when halves of the window differ too much."""

    def __init__(self, delta: float = 0.002, per_row: int = 5, every: int = 32):
        self.delta, self.per_row, self.every = delta, per_row, every
        self.rows: list[list[float]] = [[]]  # sums of buckets of 1, 2, 4, ... values, newest first
        self.n, self.total, self.seen = 0, 0.0, 0

    def update(self, x: float) -> bool:
        """Whether the mean has changed."""
        self.seen += 1
        self.n, self.total = self.n + 1, self.total + x
        self.rows[0].insert(0, x)
        for k in range(len(self.rows)):
            if len(self.rows[k]) <= self.per_row:
                break
            if k + 1 == len(self.rows):
                self.rows.append([])
            self.rows[k + 1].insert(0, self.rows[k].pop() + self.rows[k].pop())
        return self.seen % self.every == 0 and self._shrink()

    def _shrink(self) -> bool:
        cut, changed = True, False
        while cut and self.n > 10:
            cut = self._differs()
            changed = changed or cut
            if cut:
                k = len(self.rows) - 1
                self.total -= self.rows[k].pop()
                self.n -= 1 << k
                if not self.rows[k] and k:
                    self.rows.pop()
        return changed

    def _differs(self) -> bool:
        """Whether there is a bucket before and after which the means differ too much."""
        n, total = self.n, self.total
        n0, s0 = float(n), total
        var, d = max(total / n * (1 - total / n), 0), math.log(2 * math.log(n) / self.delta)
        for k, row in enumerate(self.rows):
            for s in row:
                n0, s0 = n0 - (1 << k), s0 - s
                n1 = n - n0
                if n0 < 5:
                    return False
                if n1 < 5:
                    continue
                m = 1 / (1 / n0 + 1 / n1)
                if abs(s0 / n0 - (total - s0) / n1) > math.sqrt(2 / m * var * d) + 2 / (3 * m) * d:
                    return True
        return False


class _Node:
    __slots__ = ("feature", "threshold", "left", "right", "count", "own", "mean", "m2", "features", "since", "depth", "right_by_count", "right_by_bayes")

    def __init__(self, features: list[int], depth: int, count: list[float] | None = None):
        self.feature, self.features, self.depth, self.since = -1, features, depth, 0.0
        self.count = [0.0, 0.0] if count is None else count
        self.own = [0.0, 0.0]  # of the rows that the means and variances are made of; count has the parent's share too
        self.mean, self.m2 = ([[0.0] * len(features) for _ in range(2)] for _ in range(2))
        self.right_by_count = self.right_by_bayes = 0.0  # weight of the rows that each way foretold

    def by_count(self) -> float:
        return (self.count[1] + 0.5) / (self.count[0] + self.count[1] + 1)

    def by_bayes(self, x: Sequence[float]) -> float:
        """Naive Bayes with a normal density for each class and feature; by counts until both classes have two rows."""
        own0, own1 = self.own
        if own0 < 2 or own1 < 2:
            return self.by_count()
        log, told = math.log, 0.0
        for f, mean0, mean1, m0, m1 in zip(self.features, *self.mean, *self.m2):
            if m0 > 0 or m1 > 0 or mean0 != mean1:  # where both classes have one value, so that a variance is 0, the feature tells nothing
                var0, var1, v = max(m0 / own0, 1e-12), max(m1 / own1, 1e-12), x[f]
                told += -0.5 * (log(var1) + (v - mean1) * (v - mean1) / var1) - -0.5 * (log(var0) + (v - mean0) * (v - mean0) / var0)
        odds = log((self.count[1] + 0.5) / (self.count[0] + 0.5)) + told
        return 1 / (1 + math.exp(-min(max(odds, -30.0), 30.0)))


class HoeffdingTree:
    """Leaves keep each class's mean and variance of a random set of features, and split when Hoeffding's bound allows.

    A leaf foretells by naive Bayes where that has been right more often than the class counts. A leaf has few numbers, for
    which plain floats are faster than arrays.
    """

    def __init__(self, n_features: int, rng: np.random.Generator, grace: int = 50, delta: float = 0.01, tie: float = 0.05, max_depth: int = 12):
        self.n, self.rng, self.grace, self.delta, self.tie, self.max_depth = n_features, rng, grace, delta, tie, max_depth
        self.root = self._leaf(0)

    def _leaf(self, depth: int, count: list[float] | None = None) -> _Node:
        return _Node(np.sort(self.rng.choice(self.n, max(1, round(math.sqrt(self.n))), replace=False)).tolist(), depth, count)

    def _find(self, x: Sequence[float]) -> _Node:
        node = self.root
        while node.feature >= 0:
            node = node.left if x[node.feature] <= node.threshold else node.right
        return node

    def predict(self, x: Sequence[float]) -> float:
        node = self._find(x)
        return node.by_bayes(x) if node.right_by_bayes > node.right_by_count else node.by_count()

    def learn(self, x: Sequence[float], y: int, weight: float) -> float:
        """Learns the row, and gives what `predict` gave for it before."""
        node = self._find(x)
        by_count, by_bayes = node.by_count(), node.by_bayes(x)
        foretold = by_bayes if node.right_by_bayes > node.right_by_count else by_count
        node.right_by_count += weight * ((by_count >= 0.5) == bool(y))
        node.right_by_bayes += weight * ((by_bayes >= 0.5) == bool(y))
        node.count[y] += weight
        node.own[y] += weight
        own, mean, m2 = node.own[y], node.mean[y], node.m2[y]
        for i, f in enumerate(node.features):
            v = x[f]
            d = v - mean[i]
            mean[i] += d * weight / own
            m2[i] += weight * d * (v - mean[i])
        node.since += weight
        if node.since >= self.grace and min(node.own) > 0 and node.depth < self.max_depth:
            node.since = 0.0
            self._split(node)
        return foretold

    def _split(self, node: _Node) -> None:
        c0, c1 = node.own
        total, whole, erf = c0 + c1, _entropy(c0, c1), math.erf
        found = []  # of each feature the greatest gain, its cut and the rows of each class below
        for mean0, mean1, m0, m1 in zip(*node.mean, *node.m2):
            sd0, sd1 = math.sqrt(max(m0 / c0, 1e-12)), math.sqrt(max(m1 / c1, 1e-12))
            lo, hi = min(mean0 - 2 * sd0, mean1 - 2 * sd1), max(mean0 + 2 * sd0, mean1 + 2 * sd1)
            wide0, wide1, best = sd0 * math.sqrt(2), sd1 * math.sqrt(2), None
            for share in CUTS:
                cut = lo + (hi - lo) * share
                b0, b1 = c0 * 0.5 * (1 + erf((cut - mean0) / wide0)), c1 * 0.5 * (1 + erf((cut - mean1) / wide1))
                a0, a1 = c0 - b0, c1 - b1
                gain = whole - ((b0 + b1) * _entropy(b0, b1) + (a0 + a1) * _entropy(a0, a1)) / total
                if best is None or gain > best[0]:
                    best = (gain, cut, b0, b1)
            found.append(best)
        order = sorted(range(len(found)), key=lambda i: -found[i][0])
        gain, cut, b0, b1 = found[order[0]]
        second = found[order[1]][0] if len(order) > 1 else 0.0
        bound = math.sqrt(math.log(1 / self.delta) / (2 * total))
        if gain > 1e-6 and (gain - second > bound or bound < self.tie):
            node.feature, node.threshold = node.features[order[0]], cut
            node.left, node.right = self._leaf(node.depth + 1, [b0, b1]), self._leaf(node.depth + 1, [c0 - b0, c1 - b1])
            node.mean = node.m2 = node.own = None


def _entropy(a: float, b: float) -> float:
    whole = max(a + b, 1e-12)
    p, q = min(max(a / whole, 1e-12), 1.0), min(max(b / whole, 1e-12), 1.0)
    return -(p * math.log2(p) + q * math.log2(q))


class Member:
    """A tree of the forest with what watches its errors: a warning starts a tree in the background, a drift puts that in its place."""

    def __init__(self, grow: Callable[[], HoeffdingTree]):
        self.grow, self.tree = grow, grow()
        self.background: HoeffdingTree | None = None
        self.warning, self.drift = Adwin(WARNING), Adwin(DRIFT)
        self.right = self.seen = 0

    def vote(self) -> float:
        """Weight of the tree: its share of right answers since it began; 1 before the first and where none was right."""
        return self.right / self.seen if self.right else 1.0

    def learn(self, x: Sequence[float], y: int, weight: int) -> tuple[int, int]:
        """One row, counted `weight` times; whether there was a warning, and a drift."""
        foretold = self.tree.learn(x, y, float(weight)) if weight else self.tree.predict(x)
        wrong = float((foretold >= 0.5) != bool(y))
        self.right, self.seen = self.right + (not wrong), self.seen + 1
        if weight and self.background is not None:
            self.background.learn(x, y, float(weight))
        warned = self.warning.update(wrong)
        if warned:
            self.background, self.warning = self.grow(), Adwin(WARNING)
        drifted = self.drift.update(wrong)
        if drifted:
            self.tree, self.background = self.background or self.grow(), None
            self.warning, self.drift, self.right, self.seen = Adwin(WARNING), Adwin(DRIFT), 0, 0
        return int(warned), int(drifted)


class AdaptiveForest:
    """Predict before learning; one half until the first label. Trees vote by their accuracy and are replaced as their errors drift."""

    def __init__(self, names: list[str], n_models: int = 10, lam: float = 6.0, seed: int = 42):
        self.names, self.lam, self.rng, self.seen, self.drifts, self.warnings = names, lam, np.random.default_rng(seed), 0, 0, 0
        self.members = [Member(functools.partial(HoeffdingTree, 2 * len(names), self.rng)) for _ in range(n_models)]

    def encode(self, row: dict) -> np.ndarray:
        """Each feature's value (0 if undefined), then the flags of undefined ones."""
        v = np.array([np.nan if row.get(n) is None else float(row[n]) for n in self.names])
        bad = ~np.isfinite(v)
        return np.concatenate([np.where(bad, 0.0, v), bad.astype(float)])

    def predict(self, row: dict) -> float:
        if not self.seen:
            return 0.5
        x = self.encode(row).tolist()
        p, weight = np.array([m.tree.predict(x) for m in self.members]), np.array([m.vote() for m in self.members])
        return float(min(1.0, max(0.0, (p * weight).sum() / weight.sum())))

    def learn(self, row: dict, y: int) -> None:
        x = self.encode(row).tolist()
        for member in self.members:
            warned, drifted = member.learn(x, int(y), int(self.rng.poisson(self.lam)))
            self.warnings, self.drifts = self.warnings + warned, self.drifts + drifted
        self.seen += 1


class DriftAware:
    """A model that is reset when |p - y| drifts; then it learns on."""

    def __init__(self, make, detector: Adwin | None = None):
        self.make, self.model, self.detector, self.resets = make, make(), detector or Adwin(), 0

    def predict(self, row: dict) -> float:
        return self.model.predict(row)

    def learn(self, row: dict, y: int) -> None:
        if self.detector.update(abs(self.model.predict(row) - y)):
            self.model, self.resets = self.make(), self.resets + 1
        self.model.learn(row, y)
