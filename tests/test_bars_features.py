import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelorus.functions import kernels
from pelorus.functions import scalars as S
from pelorus.operators import bars as B
from pelorus.operators import features, labels, regime
from pelorus.sources import minutes

T0 = 1_700_000_000_000


def minute_rows(spark, times, segments=None, price=100.0):
    seg = segments or [0] * len(times)
    data = [("a", t, price + i, price + i + 1, price + i - 1, price + i + 0.5, 10.0, t + 59_999, 1000.0, 5, 4.0, 400.0, s) for i, (t, s) in enumerate(zip(times, seg))]
    return spark.createDataFrame(data, "instrument string, open_time long, open double, high double, low double, close double, volume double, close_time long, quote_volume double, trades long, taker_buy_base double, taker_buy_quote double, segment_id long")


def bar_times(df):
    return [r.open_time for r in df.orderBy("open_time").collect()]


def test_count_bars_break_at_gaps_and_segments(spark):
    step = [T0 + 60_000 * i for i in range(10)]
    assert bar_times(B.count_bars(minute_rows(spark, step), 4)) == [step[0], step[4]]  # the tail of two goes
    edge = [T0, T0 + 61_000, T0 + 122_001]  # 61,000 ms is no gap, 61,001 is
    assert bar_times(B.count_bars(minute_rows(spark, edge), 2)) == [T0]
    again = minute_rows(spark, step[:6], [0, 0, 1, 1, 0, 0])  # a segment id that returns
    assert bar_times(B.count_bars(again, 2)) == [step[0], step[2], step[4]]
    bar = B.count_bars(minute_rows(spark, step[:2]), 2).first()
    assert (bar.open, bar.high, bar.low, bar.close, bar.volume, len(bar.underlying)) == (100.0, 102.0, 99.0, 101.5, 20.0, 2)


def test_empty_input(spark):
    none = minute_rows(spark, [T0]).limit(0)
    assert B.count_bars(none, 2).count() == B.time_bars(none, 2).count() == 0
    assert features.base_features(B.time_bars(none, 2)).count() == 0


def test_time_bars_keep_partial(spark):
    t = T0 // 120_000 * 120_000
    assert bar_times(B.time_bars(minute_rows(spark, [t, t + 60_000, t + 120_000]), 2)) == [t, t + 120_000]


def test_bad_rows_and_missing_columns(spark):
    df = minute_rows(spark, [T0, T0 + 60_000, T0 + 120_000, T0 + 180_000])
    bad = df.withColumn("close", F.when(F.col("open_time") == T0, float("nan")).when(F.col("open_time") == T0 + 60_000, 0.0).when(F.col("open_time") == T0 + 120_000, float("inf")).otherwise(F.col("close")))
    assert minutes.valid_rows(bad).count() == 1
    with pytest.raises(ValueError, match="trades"):
        minutes.conform(df.drop("trades"))
    assert minutes.conform(df.withColumn("extra", F.lit(1))).columns == ["instrument", *minutes.REQUIRED]


def test_cleanse(spark):
    df = minute_rows(spark, [T0, T0, T0 + 60_000, T0 + 121_001])
    df = df.withColumn("open_time", F.when(F.col("open_time") == T0 + 60_000, F.col("open_time") * 1000).otherwise(F.col("open_time")))
    assert [(r.open_time, r.segment_id) for r in minutes.cleanse(df).orderBy("open_time").collect()] == [(T0, 0), (T0 + 60_000, 0), (T0 + 121_001, 1)]


def test_synthetic_is_seeded(spark):
    a, b = minutes.synthetic(spark, 50).collect(), minutes.synthetic(spark, 50).collect()
    assert a == b and len(a) == 50 and a != minutes.synthetic(spark, 50, seed=1).collect()


def test_rolling_against_brute_force(spark):
    rng = np.random.default_rng(3)
    seg = sorted(rng.integers(0, 3, 60).tolist())[:40] + [0] * 20
    values = [None if rng.random() < 0.2 else float(rng.normal()) for _ in range(60)]
    df = spark.createDataFrame([("a", i, s, v) for i, (s, v) in enumerate(zip(seg, values))], "instrument string, open_time long, segment_id int, x double")
    specs = [features.FeatureSpec(s, "x", s, 5, 2) for s in ("mean", "var", "min", "max", "ptp", "iqr")]
    got = features.build(df, specs).orderBy("open_time").collect()
    past, last = [], None
    for i, r in enumerate(got):
        if seg[i] != last:
            past, last = [], seg[i]
        want = None
        if values[i] is not None:
            past.append(values[i])
            if len(past) - 1 >= 6:
                w = past[-7:-2]
                s = sorted(w)
                want = (np.mean(w), np.var(w, ddof=1), min(w), max(w), max(w) - min(w), s[3] - s[1])
        for spec, x in zip(specs, want or [None] * 6):
            assert (r[spec.name] is None) if x is None else math.isclose(r[spec.name], x, abs_tol=1e-12)


def test_look_ahead_is_refused():
    with pytest.raises(ValueError):
        features.FeatureSpec("x", "return", "mean", 4, 0)
    assert len(features.default_catalog()) == 606 and features.warmup(features.default_catalog()) == 97


def test_features_ignore_the_future(spark):
    df = minute_rows(spark, [T0 + 60_000 * i for i in range(30)])
    spec = [features.FeatureSpec("m", "return", "mean", 4), features.FeatureSpec("l", "return", "lag", 1, 2)]
    a = features.build(features.base_features(df), spec).where(F.col("open_time") < T0 + 60_000 * 20).select("open_time", "m", "l").orderBy("open_time").collect()
    changed = df.withColumn("close", F.when(F.col("open_time") >= T0 + 60_000 * 20, 1.0).otherwise(F.col("close")))
    assert a == features.build(features.base_features(changed), spec).where(F.col("open_time") < T0 + 60_000 * 20).select("open_time", "m", "l").orderBy("open_time").collect()


def test_first_bar_and_segment_start_return_zero(spark):
    r = features.base_features(minute_rows(spark, [T0, T0 + 60_000, T0 + 120_000], [0, 0, 1])).orderBy("open_time").collect()
    assert r[0]["return"] == 0.0 and r[1]["return"] != 0.0 and r[2]["return"] == 0.0
    assert r[2].true_range == max(2.0, abs(103.0 - 101.5), abs(101.0 - 101.5))  # the true range crosses segments


def test_regimes(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(None,), (float("nan"),)], "v double")
    cuts = regime.fit_cuts(df, "v")
    assert cuts.edges == (3.0, 6.0) and cuts.labels == ("low", "med", "high")
    assert [r[0] for r in df.select(cuts.assign()).collect()] == [0] * 4 + [1] * 3 + [2] * 3 + [0, 0]


def test_labels(spark):
    df = minute_rows(spark, [T0 + 60_000 * i for i in range(4)], [0, 0, 0, 1])
    got = labels.labels(df, 0.02).orderBy("open_time").collect()
    assert [r.label for r in got] == [0, 0, None, None]
    assert math.isclose(got[0].log_excursion, math.log(102 / 100.5))


def test_kernels():
    rng = np.random.default_rng(0)
    assert 0.35 < kernels.hurst(rng.normal(size=2000)) < 0.7 and kernels.hurst(np.cumsum(rng.normal(size=2000))) > 0.85
    assert math.isnan(kernels.hurst(np.zeros(64))) and math.isnan(kernels.hurst(np.ones(8)))
    assert kernels.sample_entropy(np.sin(np.arange(200) / 5)) < kernels.sample_entropy(rng.normal(size=200))


def plain_hurst(x):
    n, points = len(x), []
    for m in sorted({int(s) for s in np.exp(np.linspace(np.log(8), np.log(n / 2), 6))}):
        ratios = []
        for k in range(n // m):
            part = x[k * m : (k + 1) * m]
            dev = np.cumsum(part - part.mean())
            if dev.max() > dev.min() and part.std() > 0:
                ratios.append((dev.max() - dev.min()) / part.std())
        if ratios:
            points.append((math.log(m), math.log(np.mean(ratios))))
    return np.polyfit(*zip(*points), 1)[0] if len(points) > 1 else math.nan


def plain_entropy(x, m=2):
    tol, n = 0.2 * x.std(), len(x)
    near = lambda i, j, k: all(abs(x[i + d] - x[j + d]) <= tol for d in range(k))
    pairs = [(i, j) for i in range(n - m) for j in range(i + 1, n - m)]
    a, b = sum(near(i, j, m + 1) for i, j in pairs), sum(near(i, j, m) for i, j in pairs)
    return -math.log(a / b) if a and b and tol > 0 else math.nan


def test_kernels_are_brute_force():
    rng = np.random.default_rng(3)
    for n in (32, 45, 128):
        x = np.concatenate([rng.normal(size=(4, n)), np.cumsum(rng.normal(size=(2, n)), axis=1), np.zeros((1, n)), np.repeat(rng.normal(size=(1, n // 2 + 1)), 2, axis=1)[:, :n]])
        assert np.allclose(kernels.hurst.many(x), [plain_hurst(r) for r in x], equal_nan=True)
        assert np.allclose(kernels.sample_entropy.many(x[:, :45]), [plain_entropy(r) for r in x[:, :45]], equal_nan=True)
        assert math.isclose(kernels.hurst(x[0]), plain_hurst(x[0]))


def test_bounded_batch_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(kernels, "CHUNK", 16)
    rng = np.random.default_rng(5)
    x = [None if rng.random() < 0.1 else float(v) for v in rng.normal(size=400)]
    df = spark.createDataFrame([("ab"[i % 2], i, v) for i, v in enumerate(x)], "instrument string, open_time long, x double").repartition(3)

    def odd(w):
        if w[0] > 1.5:
            raise ValueError("no")
        return w.sum() + w[-1]

    got = {r.open_time: r.k for r in kernels.bounded_batch(df, "k", odd, "x", 7, 2).collect()}
    assert len(got) == 400
    for name in (0, 1):
        before = []
        for i in range(name, 400, 2):
            if x[i] is None:
                assert got[i] is None
                continue
            before.append(x[i])
            w = np.array(before[-9:-2]) if len(before) >= 9 else None
            assert got[i] is None if w is None or w[0] > 1.5 else math.isclose(got[i], w.sum() + w[-1])


def test_sliding_kernels_are_those_of_each_window():
    rng = np.random.default_rng(3)
    mixed = np.concatenate([np.zeros(300), rng.normal(size=500), np.ones(200)])
    for x in (rng.normal(size=1000), np.cumsum(rng.normal(size=1000)), np.round(rng.normal(size=1000)), mixed, rng.normal(size=70)):
        for w in (2, 3, 8, 33, 64):
            views = np.lib.stride_tricks.sliding_window_view(x, w)
            for kernel in (kernels.hurst, kernels.sample_entropy):
                assert np.allclose(kernel.slide(x, w), kernel.many(views), equal_nan=True, rtol=1e-9)
    x = np.round(np.random.default_rng(4).normal(size=1200), 1)
    views = np.lib.stride_tricks.sliding_window_view(x, 600)  # more places than the small counters hold
    assert np.allclose(kernels.sample_entropy.slide(x, 600), kernels.sample_entropy.many(views), equal_nan=True)


def test_sliding_kernels_over_chunks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = [None if i % 17 == 5 else float(v) for i, v in enumerate(rng.normal(size=1500))]
    df = spark.createDataFrame([(i // 1400 * 7, i, v) for i, v in enumerate(x)], "instrument long, open_time long, x double").repartition(3)
    monkeypatch.setattr(kernels, "CHUNK", 700)
    for kernel, plain in ((kernels.hurst, plain_hurst), (kernels.sample_entropy, plain_entropy)):
        got = {r.open_time: r.k for r in kernels.bounded_batch(df, "k", kernel, "x", 34, 2).collect()}
        for name in (0, 7):
            own = [(i, v) for i, v in enumerate(x) if i // 1400 * 7 == name and v is not None]
            for j in [*range(30, 40), *range(640, 720, 7), len(own) - 1]:
                if j < len(own):
                    want = plain(np.array([v for _, v in own[j - 35 : j - 1]])) if j >= 35 else math.nan
                    assert (got[own[j][0]] is None and not math.isfinite(want)) or math.isclose(got[own[j][0]], want, rel_tol=1e-9)
    assert len(got) == 1500 and got[5] is None


def test_catalog_names_and_kernels(spark):
    names = [s.name for s in features.default_catalog()]
    for known in ("log_quote_volume_rolling_iqr_96", "log_trades_rolling_var_2", "range_hl_lag_5", "buy_ratio_lag_10", "imbalance_rolling_ptp_48", "dow_cos_id", "return_rolling_mean_1"):
        assert known in names
    more = features.default_catalog(with_kernels=True)
    assert [s.name for s in more[606:]] == ["hurst_128", "sample_entropy_128", "dfa_alpha_128"]
    df = features.base_features(minute_rows(spark, [T0 + 60_000 * i for i in range(140)]).withColumn("close", 100 + F.abs(F.sin(F.col("open_time") / 70_001))))
    specs = [s for s in more if s.name in ("hurst_128", "dfa_alpha_128", "return_rolling_mean_4")]
    out = features.build(df, specs).orderBy("open_time").collect()
    assert [r.hurst_128 is not None for r in out] == [i >= 128 for i in range(140)] and out[130].return_rolling_mean_4 is not None
    x = np.array([r.log_close for r in out])
    assert math.isclose(out[135].hurst_128, plain_hurst(x[7:135]))


def test_drop_correlated(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=300), rng.normal(size=300)
    cols = {"a": a, "b": b, "a2": 2 * a + 1e-3 * b, "c": a + b, "d": -b + 1e-3 * a, "flat": np.ones(300), "few": np.where(np.arange(300) < 5, a, np.nan)}
    rows = [tuple(None if math.isnan(v[i]) else float(v[i]) for v in cols.values()) for i in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in cols)).repartition(5)
    assert features.drop_correlated(df, list(cols)) == ["a", "b", "c", "flat", "few"]
    value = features.correlations(df, list(cols))
    assert math.isclose(value[0, 3], abs(np.corrcoef(a, a + b)[0, 1]), abs_tol=1e-12) and value[0, 5] == value[0, 6] == 0
    specs = [features.FeatureSpec(n, s, stat, w) for n, s, stat, w in (("m8", "return", "mean", 8), ("m9", "return", "mean", 9), ("v8", "return", "var", 8), ("o8", "imbalance", "mean", 8))]
    kept = [s.name for s in features.without_alike(spark, specs, 0.9)]
    assert kept == ["m8", "v8", "o8"]


def test_scalars(spark):
    with pytest.raises(ValueError):
        S.Split(S.TimeWindow(0, 10), S.TimeWindow(11, 20), embargo=2)
    one = spark.range(1).select(S.intersection(F.lit(1), F.lit(5), F.lit(3), F.lit(9)).alias("i"), S.overlaps(F.lit(1), F.lit(3), F.lit(3), F.lit(4)).alias("o"), S.to_bps(S.from_bps(F.lit(12.0))).alias("b")).first()
    assert (one.i.start, one.i.end, one.o) == (3, 5, False) and math.isclose(one.b, 12.0)
    with pytest.raises(Exception, match="not a price"):
        spark.range(1).select(S.price(F.lit(-1.0))).collect()


def test_asymmetric_weights_without_near_misses(spark):
    """No negative is short of phi, so d* is 0: negatives weigh 1, or what `flat` says (the SQL of asym_weights: 5)."""
    df = spark.createDataFrame([("a", 0.9, 0), ("a", 0.6, 0), ("a", 2.0, 1), ("a", None, None), ("b", 0.1, 0)], "instrument string, log_excursion double, label int")
    for flat, more in ((1.0, {}), (5.0, {"flat": 5.0})):
        got = {(r.instrument, r.log_excursion): r.weight for r in labels.asymmetric_weights(df, 0.5, **more).collect()}
        assert got["a", 0.9] == got["a", 0.6] == flat and got["a", 2.0] == 1 and got["a", None] is None and math.isclose(got["b", 0.1], 5)
