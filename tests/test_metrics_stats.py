import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelorus.functions import metrics, scalars, stats


def preds(spark, y, p, regime=None):
    return spark.createDataFrame([(i, int(a), float(b), 0 if regime is None else regime[i]) for i, (a, b) in enumerate(zip(y, p))], "idx long, y int, p double, regime int")


CASES = [
    ([0, 1, 1, 0, 1, 0], [0.1, 0.9, 0.5, 0.5, 0.5, 0.2]),
    ([1, 0, 1, 0], [0.5] * 4),
    ([1, 1, 1], [0.2, 0.4, 0.9]),
    ([0, 1] * 50, list(np.random.default_rng(1).integers(0, 11, 100) / 10)),
]


@pytest.mark.parametrize("y, p", CASES)
def test_ranking(spark, y, p):
    df = preds(spark, y, p)
    y, p = np.array(y), np.array(p)
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]) if len(pos) and len(neg) else 0.5
    assert math.isclose(metrics.roc_auc(df).first().roc_auc, auc)
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    ap = sum(h / (k + 1) for k, (h, t) in enumerate(zip(hits, y[order])) if t) / max(1, y.sum())
    assert math.isclose(metrics.pr_auc(df).first().pr_auc, ap)


@pytest.mark.parametrize("y, p", CASES)
def test_ece(spark, y, p):
    edges = np.quantile(p, np.linspace(0, 1, 11))
    bins = np.searchsorted(edges[1:-1], p, "right")
    want = sum(abs(np.mean(np.array(p)[bins == b]) - np.mean(np.array(y)[bins == b])) * (bins == b).sum() for b in set(bins)) / len(p)
    assert math.isclose(metrics.ece(preds(spark, y, p)).first().ece, want, abs_tol=1e-12)


def test_empty_predictions(spark):
    df = preds(spark, [1], [0.5]).limit(0)
    assert df.agg(metrics.brier()).first()[0] == 0.0
    assert metrics.reliability(df).count() == 0 and metrics.by_regime(df).count() == 0


def test_delong_variance(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 80)
    p = rng.random(80) * 0.5 + y * 0.3
    pos, neg = p[y == 1], p[y == 0]
    v10, v01 = [(a > neg).mean() for a in pos], [(pos > b).mean() for b in neg]
    got = metrics.delong(preds(spark, y, p)).first()
    assert math.isclose(got.auc, np.mean(v10)) and math.isclose(got.variance, np.var(v10, ddof=1) / len(pos) + np.var(v01, ddof=1) / len(neg))


def test_wilson_and_normal(spark):
    lo, hi = metrics.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(lo, hi).first()) == (0.0, 1.0)
    for z in (-3.0, -0.5, 0.0, 1.0, 2.5):
        assert abs(spark.range(1).select(metrics.normal_cdf(F.lit(z))).first()[0] - metrics.NORMAL.cdf(z)) < 2e-7


def trades(spark, pnl):
    return spark.createDataFrame([(i, 0, (i + 1) * 60_000_000_000, "TP" if x > 0 else "SL", float(x)) for i, x in enumerate(pnl)], "idx long, entry_ts long, exit_ts long, reason string, pnl double")


def test_trading_edges(spark):
    assert metrics.trading(trades(spark, [0.1]).limit(0)).count() == 0
    one = metrics.trading(trades(spark, [0.1])).first()
    assert one.n_trades == 1 and one.sharpe is None and one.profit_factor is None
    flat = metrics.trading(trades(spark, [0.1] * 5)).first()
    assert flat.sharpe is None and flat.hit_rate == 1.0
    lost = metrics.cdar(trades(spark, [-0.1, 0.05, -0.2])).first()
    assert math.isclose(lost.max_drawdown, -0.2)


def test_runs_and_crossings(spark):
    flags = [False, True, True, False, True]
    df = spark.createDataFrame([(i, f, None if i == 0 else float(i % 2)) for i, f in enumerate(flags)], "idx long, flag boolean, v double")
    assert sorted(tuple(r) for r in metrics.spans(df, "flag").collect()) == [(1, 3), (4, 5)]
    assert metrics.crossings(df, "v", F.lit(0.5)).first().crossings == 2


def test_running_by_buckets(spark):
    rng = np.random.default_rng(5)
    v = rng.permutation(500)
    df = spark.createDataFrame([(0, int(x), int(x % 7)) for x in v], "g int, k long, d long")
    a = metrics.running(df, ["g"], "k", {"s": "d"}, F.floor(F.col("k") / 16)).orderBy("k").collect()
    assert [r.s for r in a] == [sum(x % 7 for x in range(k)) for k in range(500)]


def test_concurrency_and_uniqueness(spark):
    spans = [(0, 0, 4), (1, 2, 6), (2, 3, 4), (3, 9, 10)]
    df = spark.createDataFrame(spans, "trade_id long, n_open long, n_close long")
    c = np.zeros(12)
    for _, a, b in spans:
        c[a:b] += 1
    for r in stats.uniqueness(df).collect():
        _, a, b = spans[r.trade_id]
        assert math.isclose(r.uniqueness, np.mean(1 / c[a:b]))


def test_cscv_pbo(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, 40))
    df = spark.createDataFrame([(s, t, float(x[s, t])) for s in range(3) for t in range(40)], "strategy int, period long, r double")
    got = {r.combo: r for r in stats.cscv_pbo(df, 4).collect()}
    chunks = x.reshape(3, 4, 10)
    for i, inside in enumerate(itertools.combinations(range(4), 2)):
        out = [k for k in range(4) if k not in inside]
        sr = lambda ks: np.array([(v := chunks[s, list(ks)].ravel()).mean() / v.std(ddof=1) for s in range(3)])
        best = int(sr(inside).argmax())
        rank = int((sr(out) < sr(out)[best]).sum()) + 1
        assert (got[i].best, got[i].rank) == (best, rank)


def test_bootstrap(spark):
    x = np.random.default_rng(1).normal(0.1, 1, 200)
    a, b = (stats.bootstrap(spark, x, np.mean, 200).first() for _ in range(2))
    assert a == b and a.lo < a.point < a.hi and a.n_finite == 200
    assert stats.bootstrap(spark, np.zeros(0), np.mean, 10).first().n_finite == 0
    assert 1 <= stats.block_length(x) <= 50
    idx = stats.stationary_indices(100, 5, np.random.default_rng(0))
    assert len(idx) == 100 and 0.6 < np.mean(np.diff(idx) % 100 == 1) < 0.95


def plain_block_length(x):
    n = len(x)
    most = min(n // 4, max(8, math.ceil(8 * math.log10(n))))
    d = x - x.mean()
    cov = [float((d * d).mean())] + [float((d[k:] * d[:-k]).mean()) for k in range(1, most + 1)]
    line, run = 2 * math.sqrt(math.log10(n) / n), max(5, math.ceil(math.sqrt(math.log10(n))))
    m = most
    for k in range(1, most + 1):
        if k + run <= most and all(abs(cov[j] / cov[0]) < line for j in range(k, k + run + 1)):
            m = k
            break
    g, s = 0.0, cov[0]
    for k in range(1, m + 1):
        w = 1.0 if 2 * k <= m else 2 * (1 - k / m)
        s, g = s + 2 * w * cov[k], g + 2 * w * k * cov[k]
    b = (2 * g * g / (s * s)) ** (1 / 3) * n ** (1 / 3)
    return 1 if b < 1 else max(1, min(round(b), n // 4))


def test_block_length():
    rng = np.random.default_rng(0)
    for rho in (0.0, 0.3, 0.9):
        for n in (20, 200, 2000):
            x = np.zeros(n)
            for i in range(1, n):
                x[i] = rho * x[i - 1] + rng.normal()
            assert stats.block_length(x) == plain_block_length(x)
    assert stats.block_length(np.ones(27)) == 3
    with pytest.raises(ValueError):
        stats.block_length(np.zeros(7))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(size=501), "b": np.repeat([1.0, 2.0], [300, 5]), "c": np.array([4.0])}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("d", None)], "g string, v double").repartition(4)
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.999, 1.0]
    got = {r.g: r.quantiles for r in metrics.quantiles(df, "v", shares, ["g"]).collect()}
    assert got.keys() == groups.keys() and all(np.allclose(got[g], np.quantile(x, shares), rtol=1e-12) for g, x in groups.items())
    assert np.allclose(metrics.quantiles(df, "v", [0.25]).first()[0], np.quantile(np.concatenate(list(groups.values())), 0.25))
    assert metrics.quantiles(df.limit(0), "v", [0.5]).count() == 0


def test_one_probability_for_most_rows(spark):
    """A p that most rows share: its rows are many buckets, and the results those of plain loops."""
    rng = np.random.default_rng(9)
    p = np.where(rng.random(800) < 0.7, 0.25, np.round(rng.random(800), 3))
    y = (rng.random(800) < p).astype(int)
    df = spark.createDataFrame([(i, int(b), float(a)) for i, (a, b) in enumerate(zip(p, y))], "idx long, y int, p double").repartition(4)
    order = sorted(range(800), key=lambda i: (-p[i], i))
    hits = np.cumsum([y[i] for i in order])
    want = sum(hits[k] / (k + 1) for k, i in enumerate(order) if y[i]) / y.sum()
    assert math.isclose(metrics.pr_auc(df).first().pr_auc, want)
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert math.isclose(metrics.roc_auc(df).first().roc_auc, auc) and math.isclose(metrics.delong(df).first().auc, auc)
    at, bucket = metrics.bucketed(df)
    assert df.where("p = 0.25").select(bucket.alias("b")).distinct().count() > 50


def test_rolling_brier_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(metrics, "CHUNK", 40)
    rng = np.random.default_rng(4)
    p, y = rng.random(300), rng.integers(0, 2, 300)
    df = spark.createDataFrame([(3 * i, int(b), float(a)) for i, (a, b) in enumerate(zip(p, y))], "idx long, y int, p double").repartition(4)
    err = (p - y) ** 2
    for r in metrics.rolling_brier(df, 10).collect():
        i = r.idx // 3
        assert math.isclose(r.baseline, err.mean()) and (r.rolling_brier is None if i < 9 else math.isclose(r.rolling_brier, err[i - 9 : i + 1].mean()))


def test_deflated_sharpe():
    assert metrics.deflated_sharpe(2.0, 1.0, 1, 100)[0] > metrics.deflated_sharpe(2.0, 1.0, 100, 100)[0]
    assert metrics.probabilistic_sharpe(0.0, 50) == 0.5


def test_sharpe_interval(spark):
    x = np.random.default_rng(1).normal(0.2, 1, 3000)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "instrument string, idx long, pnl double")
    lo, hi = stats.sharpe_interval(df, "instrument", ["idx"], "pnl")
    assert lo < x.mean() / x.std(ddof=1) < hi and hi - lo < 0.15
    assert math.isnan(stats.sharpe_interval(df.limit(0), "instrument", ["idx"], "pnl")[0])


def test_intervals_are_of_all_resamples(spark, data):
    from pelorus.functions import metrics, resampling
    from pelorus.plans import queries
    from pelorus.sources import fixtures

    p = fixtures.predictions(spark, data).withColumn("se", metrics.squared_error()).toPandas()
    t = fixtures.trades(spark, data).toPandas()
    for name, rows, key, value, stat, n in (("bootstrap_ci", t, "series", "pnl", stats.sharpe, 5000), ("drawdown_ci", t, "series", "pnl", stats.max_drawdown, 1000), ("brier_intervals", p, "regime", "se", np.mean, 1000)):
        got = {r[key]: (r.point, r.lo, r.hi) for r in queries.QUERIES[name](spark, data).collect()}
        assert got.keys() == set(rows[key])
        for k, part in rows.groupby(key):
            x = part.sort_values("idx")[value].to_numpy()
            if len(x) >= 8:
                draws = [stat(x[resampling.indices(len(x), stats.block_length(x), 42, b)]) for b in range(n)]
                assert np.allclose(got[k], [stat(x), *np.quantile(draws, [0.025, 0.975])], atol=2e-6)
    got = {r.regime: (r.lo, r.hi) for r in queries.QUERIES["pr_auc_intervals"](spark, data).collect()}
    part = p[p.regime == 1]
    draws = [stats.stratified_pr_auc(part["y"].to_numpy(), part["p"].to_numpy(), np.random.default_rng([42, b])) for b in range(1000)]
    assert np.allclose(got[1], np.quantile(draws, [0.025, 0.975]), atol=0.01)


def test_null_groups_keep_their_rows(spark):
    """A null key is a group like others in bins, quantiles, ranks and running sums."""
    from pelorus.functions import metrics

    rows = [(i, i % 2, i / 40, None if i % 4 < 2 else 1) for i in range(40)]
    df = spark.createDataFrame(rows, "idx long, y int, p double, regime int")
    for got in (metrics.ece(df, 4, ["regime"]), metrics.roc_auc(df, ["regime"]), metrics.quantiles(df, "p", [0.5], ["regime"])):
        assert {r.regime for r in got.collect()} == {None, 1}
    alone = {None: metrics.ece(df.where("regime IS NULL"), 4).first().ece, 1: metrics.ece(df.where("regime = 1"), 4).first().ece}
    assert all(math.isclose(r.ece, alone[r.regime]) for r in metrics.ece(df, 4, ["regime"]).collect())
    summed = metrics.running(df, ["regime"], "idx", {"before": "y"}, F.floor(F.col("idx") / 7))
    assert summed.count() == 40 and summed.where("regime IS NULL").agg(F.max("before")).first()[0] == 9


def test_buckets_grow_with_rows(spark, monkeypatch):
    from pelorus.functions import metrics

    df = spark.range(5000).withColumn("x", F.col("id").cast("double"))
    assert len(metrics.cuts(df, ["x"])[0]) == 127
    monkeypatch.setattr(metrics, "CHUNK", 5)
    assert len(metrics.cuts(df, ["x"])[0]) > 900


def test_periods_without_rows_count_as_zero(spark):
    rng = np.random.default_rng(9)
    dense = [(s, t, float(rng.normal()) if rng.random() < 0.3 else 0.0) for s in range(3) for t in range(64)]
    full = spark.createDataFrame(dense, "strategy int, period long, r double")
    key = lambda df: sorted((r.combo, r.best, r["rank"]) for r in df.collect())
    assert key(stats.cscv_pbo(full.where("r <> 0"), 4, periods=64)) == key(stats.cscv_pbo(full, 4))


@pytest.mark.parametrize("bucket_rows", [None, 3])
def test_paths_in_buckets_are_plain_loops(spark, monkeypatch, bucket_rows):
    """Equity, drawdowns, CDaR, crossings and runs of a flag by buckets of a series, with ties of time, a null key and a key of one row."""
    if bucket_rows:
        cuts = metrics.cuts
        monkeypatch.setattr(metrics, "cuts", lambda df, columns, n=None: cuts(df, columns, 40))
    rng = np.random.default_rng(11)
    rows = [(k, i, int(i // 3), float(rng.normal()), bool(rng.random() < 0.4)) for k, n in (("a", 200), (None, 37), ("b", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "series string, idx long, exit_ts long, pnl double, flag boolean").repartition(4)
    worst, ups, runs = {}, {}, []
    for k in ("a", None, "b"):
        own = [r for r in rows if r[0] == k]
        level = np.cumsum([r[3] for r in own])
        down = np.maximum.accumulate(level) - level
        got = metrics.equity(df, ["series"]).where(F.col("series").eqNullSafe(F.lit(k))).orderBy("idx").collect()
        assert np.allclose([(r.equity, r.drawdown) for r in got], np.stack([level, down], axis=1), atol=1e-9)
        m = max(1, int(len(own) * 0.05))
        worst[k] = (-down.max(), -np.sort(down)[::-1][:m].mean())
        above = [r[3] > 0.2 for r in own]
        ups[k] = sum(a and not (i and above[i - 1]) for i, a in enumerate(above))
        for flag, part in itertools.groupby(enumerate(r[4] for r in own), key=lambda x: x[1]):
            part = list(part)
            if flag:
                runs.append((k or "", part[0][0], part[-1][0] + 1))
    for r in metrics.cdar(df, by=["series"]).collect():
        assert np.allclose(worst[r.series], (r.max_drawdown, r.cdar), atol=1e-9)
    assert {r.series: r.crossings for r in metrics.crossings(df, "pnl", F.lit(0.2), ["series"]).collect()} == ups
    assert sorted((r.series or "", r.start, r.end) for r in metrics.spans(df, "flag", ["series"]).collect()) == sorted(runs)


def test_cscv_of_many_strategies_is_a_plain_loop(spark):
    """Ranks and best strategies of all sets, with ties, a strategy without rows in some chunks, and strategies over several tasks."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(40, 48))
    x[7] = x[3]
    rows = [(s, t, float(x[s, t])) for s in range(40) for t in range(48) if not (s == 5 and t < 24)]
    df = spark.createDataFrame(rows, "strategy int, period long, r double").repartition(3)
    got = {r.combo: (r.best, r["rank"], r.logit) for r in stats.cscv_pbo(df, 6).collect()}
    sets = list(itertools.combinations(range(6), 3))
    assert len(got) == len(sets)
    for k, chosen in enumerate(sets):
        def sharpe(s, inside):
            v = [x[s, t] for t in range(48) if ((t // 8) in chosen) == inside and not (s == 5 and t < 24)]
            return np.mean(v) / max(np.std(v, ddof=1), 1e-12) if v else -np.inf

        inside, outside = [sharpe(s, True) for s in range(40)], [sharpe(s, False) for s in range(40)]
        best = int(np.argmax(np.round(inside, 12)))
        rank = 1 + sum(o < outside[best] - 1e-12 for o in outside)
        assert got[k][:2] == (best, rank)
        assert math.isclose(got[k][2], math.log((rank - 0.5) / 40 / (1 - (rank - 0.5) / 40)))


def test_nanoseconds_to_milliseconds_are_exact(spark):
    """A whole millisecond stays the same one: the nearest double of its nanoseconds can be below it."""
    ms = [1704067705002, 1704072749466, 1704067415746, 0, -1, -1704067705002]
    ns = [(m * 10**6 + rest, m) for m in ms for rest in (0, 1, 999_999)] + [(None, None)]
    got = spark.createDataFrame(ns, "ns long, ms long").withColumn("got", scalars.ns_to_ms(F.col("ns")))
    assert [r.got for r in got.collect()] == [m for _, m in ns] and dict(got.dtypes)["got"] == "bigint"
