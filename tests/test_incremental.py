"""Features of one pass against the window functions, and their pieces against plain loops."""

import math
import random

import numpy as np
import pytest

from pelorus.operators import features, incremental


@pytest.mark.parametrize("w", [1, 2, 3, 4, 7, 96])
def test_pieces_are_plain(w):
    v = np.random.default_rng(w).normal(size=300)
    views = [v[i : i + w] for i in range(300 - w + 1)]
    mean, var = incremental.moments(v, w)
    assert np.allclose(mean, [x.mean() for x in views]) and np.allclose(var, [x.var(ddof=1) if w > 1 else 0 for x in views])
    assert (incremental.extremes(v, w, True) == [x.min() for x in views]).all() and (incremental.extremes(v, w, False) == [x.max() for x in views]).all()
    want = [np.sort(x)[min(w - 1, int(w * 0.75))] - np.sort(x)[int(w * 0.25)] if w >= 4 else np.nan for x in views]
    assert np.allclose(incremental.interquartile(v, w), want, equal_nan=True)


def test_one_pass_gives_what_windows_give(spark, monkeypatch):
    """Several instruments, runs of segments that return, nulls, batches that end within runs."""
    r, rows = random.Random(4), []
    for key in ("a", "b", "c"):
        segment = 0
        for t in range(260):
            segment = r.choice([0, 1]) if r.random() < 0.03 else segment
            rows.append((key, t, segment, None if r.random() < 0.2 else r.gauss(0, 1), r.gauss(5, 2)))
    df = spark.createDataFrame(rows, "instrument string, open_time long, segment_id long, x double, y double").repartition(4)
    specs = [features.FeatureSpec(f"{s}_{stat}_{w}_{lag}", s, stat, w, lag) for s in ("x", "y") for stat in incremental.STATS for w, lag in ((1, 1), (2, 1), (5, 3), (12, 1))]
    key = lambda row: (row.instrument, row.open_time)
    monkeypatch.setattr(features, "MANY", 10_000)
    want = sorted(features.build(df, specs).collect(), key=key)
    monkeypatch.setattr(features, "MANY", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        made = features.build(df, specs)
        got = sorted(made.collect(), key=key)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert made.columns == [*df.columns, *(s.name for s in specs)] and len(got) == len(want) == 780
    for a, b in zip(got, want):
        for name in made.columns:
            assert a[name] == b[name] or math.isclose(a[name], b[name], rel_tol=1e-9, abs_tol=1e-9), (name, a[name], b[name])
    assert features.build(df.limit(0), specs).count() == 0


def test_a_registered_statistic_stays_a_window(spark, monkeypatch):
    monkeypatch.setattr(features, "MANY", 1)
    monkeypatch.setitem(features.STATS, "mean", lambda x, w: features.F.max(x).over(w))
    df = spark.createDataFrame([("a", t, 0, float(t)) for t in range(5)], "instrument string, open_time long, segment_id long, x double")
    got = features.build(df, [features.FeatureSpec("m", "x", "mean", 2), features.FeatureSpec("n", "x", "min", 2)]).orderBy("open_time").collect()
    assert [x.m for x in got] == [None, None, 1.0, 2.0, 3.0] and [x.n for x in got] == [None, None, 0.0, 1.0, 2.0]
