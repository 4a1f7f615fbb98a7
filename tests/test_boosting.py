"""The offline model: blocks against one task, quality on a known function, early stop, odd rows."""

import math

import numpy as np
import pandas as pd
import pytest

from pelorus.operators import boosting, offline

SMALL = offline.Params(iterations=6, depth=3, rate=0.2, leaf_steps=2, patience=10)


def made(n, columns, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, columns))
    x[rng.random(x.shape) < 0.05] = np.nan
    z = np.nan_to_num(x)
    odds = 1.5 * z[:, 0] * z[:, 1] + np.sin(2 * z[:, 2]) + 0.5 * (z[:, 3] > 0.5) - 2.2
    p = 1 / (1 + np.exp(-odds))
    frame = pd.DataFrame(x, columns=[f"f{i}" for i in range(columns)])
    frame["label"], frame["late"], frame["weight"] = (rng.random(n) < p).astype(int), np.arange(n) >= n * 0.8, 1.0
    return frame, p


@pytest.fixture(scope="module")
def train(spark):
    frame = spark.createDataFrame(made(2000, 4, 1)[0]).cache()
    frame.count()
    return frame


NAMES = [f"f{i}" for i in range(4)]


def test_blocks_give_what_one_task_gives(spark, train, monkeypatch):
    """One block of many tasks' jobs is the local fit; with more blocks only the random weights differ."""
    monkeypatch.setattr(boosting, "STORE", 2)
    one = offline.fit(train, NAMES, (1, 2), None, "late", SMALL)
    block = offline.fit(train, NAMES, (1, 2), None, "late", SMALL, rows=100)
    for a, b in zip(one, block):
        assert [(t.columns, t.borders) for t in a.trees] == [(t.columns, t.borders) for t in b.trees]
        assert np.allclose([t.leaves for t in a.trees], [t.leaves for t in b.trees])
    monkeypatch.setattr(boosting, "BLOCK", 500)
    many = offline.fit(train, NAMES, (1,), "weight", None, SMALL, rows=100)
    assert len(many[0].trees) == 6
    got = [offline.evaluate(offline.score(train, m)).first().log_loss for m in (one[:1], many)]
    assert abs(got[0] - got[1]) < 0.02


def test_processes_give_what_the_cluster_gives(spark, train, monkeypatch):
    """Blocks dealt to a task's processes, and the same blocks over the cluster with a job for each question: the same trees."""
    monkeypatch.setattr(boosting, "BLOCK", 300)
    odd = train.selectExpr(*NAMES, "label", "late", "IF(f0 > 1, 0.5D, 1 + rand(3)) AS weight").cache()
    one = offline.fit(odd, NAMES, (1, 2), "weight", "late", SMALL)
    over = offline.fit(odd, NAMES, (1, 2), "weight", "late", SMALL, rows=100)
    for a, b in zip(one, over):
        assert len(a.trees) == 6 and [(t.columns, t.borders) for t in a.trees] == [(t.columns, t.borders) for t in b.trees]
        assert np.allclose([t.leaves for t in a.trees], [t.leaves for t in b.trees], atol=1e-9)


@pytest.mark.parametrize("columns", [3, 11])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_a_part_answers_as_its_blocks(columns, kind):
    """Chunks, the smaller halves and the scores in buckets change no sum."""
    rng, params = np.random.default_rng(7), boosting.Params(depth=4, borders=20)
    make = lambda k, n: boosting.Block(k, rng.integers(0, 22, (columns, n)).astype(kind), (rng.random(n) < 0.3).astype(float), rng.random(n), rng.random(n) < 0.8, {1: rng.normal(-1, 2, n)})
    blocks = [make(0, 20_000), make(5, 900), make(6, 1)]
    part, tree = boosting.Part(blocks, 1, params), boosting.Tree([], [], [])
    for nth in range(2):
        for column, border in ((2, 17), (0, 3), (2, 5), (1, 10)):
            assert np.allclose(part.by_node(tree, nth), sum(boosting.by_node(b, 1, tree, nth, params) for b in blocks), atol=1e-8)
            tree.columns.append(column)
            tree.borders.append(border)
        for tree.leaves in ([0.0] * 16, rng.normal(size=16).tolist(), [-4.0] * 16):
            assert np.allclose(part.by_leaf(tree, nth), sum(boosting.by_leaf(b, 1, tree, nth, params) for b in blocks), atol=1e-8)
        assert np.allclose(part.loss(tree, nth), sum(boosting.loss(b, 1, tree, nth, params) for b in blocks))
        part.keep(tree, nth)
        for b in blocks:
            b.apply(1, [tree])
        tree = boosting.Tree([], [], [])


def test_leaf_steps_stay_within_bounds(spark):
    """A leaf far off the first score: steps of Newton's alone overshoot there and grow without end."""
    frame = pd.DataFrame({"f0": [0.0] * 9000 + [1.0] * 1000, "label": ([1] + [0] * 17) * 500 + ([1] * 6 + [0] * 4) * 100})
    model = offline.fit(spark.createDataFrame(frame), ["f0"], (1,), params=offline.Params(iterations=1, depth=1, rate=1.0))
    got = {r.f0: r.p_offline for r in offline.score(spark.createDataFrame(frame), model).collect()}
    assert got[0.0] == pytest.approx(1 / 18, abs=1e-3) and got[1.0] == pytest.approx(0.6, abs=1e-3)


def test_ensemble_learns_and_stops(spark, train, tmp_path):
    params = offline.Params(iterations=150, depth=4, rate=0.1, leaf_steps=3, patience=15)
    models = offline.fit(train, NAMES, (1, 2), None, "late", params)
    assert all(10 < len(m.trees) < 150 for m in models)
    frame, p = made(3000, 4, 2)
    scored = offline.score(spark.createDataFrame(frame), models)
    got, y = offline.evaluate(scored).first(), frame.label.to_numpy()
    best = -(y * np.log(p) + (1 - y) * np.log1p(-p)).mean()
    plain = -(y.mean() * math.log(y.mean()) + (1 - y.mean()) * math.log(1 - y.mean()))
    assert got.n == 3000 and best < got.log_loss < best + 0.6 * (plain - best)
    assert scored.where("sigma_ve < 0 OR p_offline <= 0 OR p_offline >= 1").count() == 0
    offline.save(models, f"{tmp_path}/m")
    again = offline.score(spark.createDataFrame(frame), offline.load(spark, f"{tmp_path}/m", 2))
    assert offline.evaluate(again).first() == got
    alone = offline.score(spark.createDataFrame(frame[:5]), models[:1]).collect()
    assert all(r.sigma_ve == 0 for r in alone)


def plain_question(block, node, nodes, l2, borders):
    """The best split of all nodes together by trying every one."""
    best = (-1.0, 0, 0)
    _, _, g, h = block.drawn
    for c, bins in enumerate(block.bins):
        for b in range(borders + 1):
            gain = 0.0
            for k in range(nodes):
                for side in ((node == k) & (bins <= b), (node == k) & (bins > b)):
                    gain += g[side].sum() ** 2 / (h[side].sum() + l2)
            if gain > best[0] + 1e-9:
                best = (gain, c, b)
    return best[1:]


def test_questions_are_the_best():
    rng = np.random.default_rng(5)
    params = boosting.Params(depth=3, borders=6, iterations=1, leaf_steps=1)
    x = list(rng.normal(size=(3, 400)))
    cuts = [sorted(np.quantile(v, np.arange(1, 7) / 7)) for v in x]
    block = boosting.Block(0, boosting.quantised(x, cuts), (x[0] * x[1] > 0).astype(float), np.ones(400), np.ones(400, bool), {3: np.zeros(400)})
    ask = lambda q, now, nth: {s: q(block, s, t, nth, params) for s, t in now.items()}
    tree = boosting.boosted([3], 0.0, params, ask, lambda now: None, False)[3][0]
    for k in range(3):
        node = boosting.Tree(tree.columns[:k], tree.borders[:k], []).leaf(block.bins)
        assert plain_question(block, node, 1 << k, params.l2, 6) == (tree.columns[k], tree.borders[k])


def test_rows_without_labels_or_one_class(spark, train):
    odd = train.selectExpr(*NAMES, "CAST(NULL AS INT) AS label")
    for df, p in ((odd, 0.0), (train.limit(0), 0.0), (train.where("label = 1"), 1.0)):
        models = offline.fit(df, NAMES, (1,), params=SMALL)
        assert models[0].trees == []
        assert {round(r.p_offline, 9) for r in offline.score(train.limit(3), models).collect()} == {p}
    assert offline.score(train.limit(0), offline.fit(train, NAMES, (1,), params=SMALL)).count() == 0
