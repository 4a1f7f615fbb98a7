"""Resamples over many tasks against those in memory, with the same seeds."""

import math
import tracemalloc

import numpy as np
import pytest

from pelorus.functions import resampling, stats


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(1)
    x, e = np.zeros(9000), rng.normal(size=9000)
    for i in range(1, len(x)):
        x[i] = 0.7 * x[i - 1] + e[i] + 0.01
    return x


METRICS = {"sharpe": stats.sharpe, "sortino": stats.sortino, "mean": np.mean, "max_drawdown": stats.max_drawdown}


@pytest.mark.parametrize("whole", [None, 100])
@pytest.mark.parametrize("metric", ["sharpe", "sortino", "max_drawdown"])
def test_tasks_give_what_memory_gives(spark, series, monkeypatch, metric, whole):
    """Whole series, and blocks dealt to buckets; a null key, a short series and one without losses."""
    monkeypatch.setattr(resampling, "BUCKET", 700)
    monkeypatch.setattr(resampling, "CHUNK", 2000)
    rows = [("a", i, float(v)) for i, v in enumerate(series)] + [(None, i, float(v)) for i, v in enumerate(series[:500])] + [("s", i, 1.0 * i) for i in range(5)] + [("a", 77_777, None)]
    df = spark.createDataFrame(rows, "g string, idx long, v double").repartition(3)
    got = {(r.key.k, r.resample): r.value for r in resampling.samples(df, "g", "v", "idx", metric, 70, 42, None, whole).collect()}
    assert len(got) == 71 + 71 + 1
    for key, x in (("a", series), (None, series[:500])):
        block = stats.block_length(x)
        for b in range(-1, 70):
            want = METRICS[metric](x if b < 0 else x[resampling.indices(len(x), block, 42, b, 2000)])
            assert math.isclose(got[key, b], want, rel_tol=1e-9, abs_tol=1e-9)
    want = METRICS[metric](np.arange(5.0))
    assert got["s", -1] is None if math.isnan(want) else math.isclose(got["s", -1], want)


def test_blocks_of_one_value_and_long_blocks(spark, series, monkeypatch):
    monkeypatch.setattr(resampling, "BUCKET", 700)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(series[:1500])], "g int, idx long, v double")
    for block in (1, 374):
        for whole in (None, 10):
            got = {r.resample: r.value for r in resampling.samples(df, "g", "v", "idx", "mean", 10, 1, block, whole).collect()}
            assert all(math.isclose(got[b], np.mean(series[:1500][resampling.indices(1500, block, 1, b)]), rel_tol=1e-9, abs_tol=1e-12) for b in range(10))


def test_drawn_blocks_are_stationary():
    n, block = 200_000, 7
    at = resampling.indices(n, block, 5, 3)
    assert len(at) == n and at.min() >= 0 and at.max() < n
    assert abs(np.mean(np.diff(at) % n != 1) - 1 / block) < 0.005
    assert abs(np.mean(at) / n - 0.5) < 0.01
    one = np.concatenate([np.repeat(s, k) + np.arange(k) for s, k in [resampling.chunk_blocks(n, block, 5, 3, c) for c in range(4)] for s, k in zip(s, k)])
    assert (one == at).all()


def test_paths_merge():
    rng = np.random.default_rng(2)
    x = rng.normal(size=1000)
    falls = resampling.Falls(x)
    at, size = np.array([0, 3, 500, 999, 17]), np.array([1000, 1, 400, 1, 33])
    for k, (s, high, low, fall) in enumerate(falls.of(at, size).T):
        level = np.cumsum(x[at[k] : at[k] + size[k]])
        assert np.allclose([s, high, low, fall], [level[-1], level.max(), level.min(), (np.maximum.accumulate(level) - level).max()])
    cuts = np.sort(rng.choice(np.arange(1, 1000), 20, replace=False))
    parts = falls.of(np.concatenate([[0], cuts]), np.diff(np.concatenate([[0], cuts, [1000]])))
    whole, groups = resampling.folded(parts, np.zeros(21, int))
    assert groups.tolist() == [0] and np.allclose(whole[:, 0], falls.of(np.array([0]), np.array([1000]))[:, 0])


def test_pr_auc_by_buckets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(3000), 2)
    y = (rng.random(3000) < p * 0.3).astype(int)
    df = spark.createDataFrame([(0, int(a), float(b)) for a, b in zip(y, p)] + [(1, 0, 0.5), (None, 1, 0.5), (None, 0, 0.4)], "g int, y int, p double")
    for levels in (1 << 16, 7):
        monkeypatch.setattr(resampling, "LEVELS", levels)
        got = {(r.key.k, r.resample): r.value for r in resampling.pr_auc_samples(df, "g", 200).collect()}
        assert len(got) == 2 * 201 and got[None, -1] == 1.0
        order = np.argsort(-p, kind="stable")
        hits = np.cumsum(y[order])
        last = np.append(np.flatnonzero(np.diff(p[order])), len(p) - 1)
        assert math.isclose(got[0, -1], (np.diff(hits[last] / y.sum(), prepend=0) * hits[last] / (last + 1)).sum())
        plain = [stats.stratified_pr_auc(y, p, np.random.default_rng(b)) for b in range(400)]
        mine = [got[0, b] for b in range(200)]
        assert abs(np.mean(mine) - np.mean(plain)) < 0.004 and abs(np.std(mine) / np.std(plain) - 1) < 0.25


def test_sequential_bootstrap_draws_by_uniqueness(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BUCKET", 16)
    rows = [(i, 0, 100, "a", 1.0) for i in range(50)] + [(50 + i, 1000 + 10 * i, 1005 + 10 * i, "a", 3.0) for i in range(50)]
    df = spark.createDataFrame(rows, "trade_id long, n_open long, n_close long, series string, pnl double")
    r = stats.sequential_bootstrap(df, "series", "pnl", "mean", 300).first()
    share = 50 / (50 + 50 / 50)  # trades that overlap share one weight
    assert math.isclose(r.point, 2.0) and r.lo < 1 + 2 * share < r.hi and r.hi - r.lo < 0.2
    even = resampling.weighted_samples(df.withColumn("w", df.pnl * 0), "series", "pnl", "w", "trade_id", "mean", 300)
    assert abs(np.mean([x.value for x in even.where("resample >= 0").collect()]) - 2.0) < 0.05
    with pytest.raises(ValueError):
        resampling.weighted_samples(df, "series", "pnl", "n_open", "trade_id", "max_drawdown")


def test_a_long_series_takes_no_more_memory_than_a_chunk():
    """Resamples of a mapped series are made chunk by chunk: no array, of draws or prefix sums, is as long as the series."""
    n = 2_000_000
    with resampling.room(n, 100) as x:
        x[:] = np.random.default_rng(1).normal(size=n)
        tracemalloc.start()
        for metric in ("sharpe", "sortino", "max_drawdown"):
            for block in (1, 20):
                sums, fall = resampling.resampled(x, float(x.mean()), block, 1, [-1, 0], metric)
                assert (sums[0, 1] != sums[0, 0]) == (metric != "max_drawdown") and (fall > 0).all() == (metric == "max_drawdown")
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert most < 8 * n


def test_alias_table_draws_by_weight():
    rng = np.random.default_rng(4)
    w = np.concatenate([rng.random(500), np.zeros(20), [50.0]])
    drawn = np.bincount(resampling.alias_draws(resampling.alias_table(w), 1_000_000, rng), minlength=len(w))
    want = 1_000_000 * w / w.sum()
    assert len(drawn) == len(w) and not drawn[500:520].any() and (np.abs(drawn - want) <= 6 * np.sqrt(want) + 6).all()
    assert (resampling.alias_draws(resampling.alias_table(np.ones(3)), 0, rng) == []).all()
