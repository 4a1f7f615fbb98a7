"""Leaves that choose between class counts and naive Bayes, and votes by accuracy."""

import math

import numpy as np

from pelorus.operators.online import AdaptiveForest, HoeffdingTree, Member


def grown(x, y, **kwargs):
    tree = HoeffdingTree(x.shape[1], np.random.default_rng(0), **kwargs)
    for row, label in zip(x, y):
        tree.learn(row, int(label), 1.0)
    return tree


def test_a_leaf_is_naive_bayes_where_that_is_better():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    x = rng.normal(size=(400, 1)) + 3.0 * y[:, None]
    tree = grown(x, y, grace=10**9)  # it never splits
    leaf = tree.root
    assert leaf.right_by_bayes > leaf.right_by_count
    mean, var, n = ([x[y == c, 0].mean() for c in (0, 1)], [x[y == c, 0].var() for c in (0, 1)], [(y == c).sum() for c in (0, 1)])
    for v in (-1.0, 1.4, 3.0):
        dense = [(n[c] + 0.5) * math.exp(-((v - mean[c]) ** 2) / (2 * var[c])) / math.sqrt(var[c]) for c in (0, 1)]
        assert math.isclose(tree.predict(np.array([v])), dense[1] / sum(dense), rel_tol=1e-6)


def test_a_leaf_counts_where_bayes_is_no_better():
    rng = np.random.default_rng(2)
    y = (rng.random(300) < 0.1).astype(int)
    tree = grown(np.zeros((300, 2)), y, grace=10**9)
    assert math.isclose(tree.predict(np.zeros(2)), (y.sum() + 0.5) / 301)
    assert grown(np.zeros((0, 2)), []).predict(np.zeros(2)) == 0.5


def test_moments_below_a_split_are_those_of_its_rows():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 4000)
    x = rng.normal(size=(4000, 1)) + 10 + 4.0 * y[:, None]
    tree = grown(x, y)
    assert tree.root.feature == 0
    for leaf in (tree.root.left, tree.root.right):
        while leaf.feature >= 0:
            leaf = leaf.left if leaf.left.own is not None else leaf.right
        assert all(leaf.own[c] == 0 or 5 < leaf.mean[c][0] < 20 for c in (0, 1))  # never drawn to 0 by the parent's counts


def test_votes_are_by_accuracy():
    forest = AdaptiveForest(["a"], n_models=2)
    forest.seen = 1
    for member, p, right in zip(forest.members, (0.9, 0.1), (3, 1)):
        member.tree.predict = lambda x, p=p: p
        member.right, member.seen = right, 4
    assert math.isclose(forest.predict({"a": 1.0}), (0.75 * 0.9 + 0.25 * 0.1) / 1.0)
    assert Member(lambda: None).vote() == 1.0
