"""First touch by a hierarchy of extrema against a plain loop."""

import math
import random

import numpy as np
import pytest

from pelorus.operators import broker


def plain(entry, minutes, horizon, tie):
    i, instrument, ts, price, side, tp, sl = entry
    if None in (instrument, ts, price):
        return "OPEN", None
    up, down = (price * math.exp(side * tp), price * math.exp(-side * sl))
    for key, at, high, low, _ in sorted(minutes, key=lambda m: (m[1], m[4])):
        if key == instrument and ts < at <= ts + horizon:
            t = (high is not None and high >= up) if side > 0 else (low is not None and low <= up)
            s = (low is not None and low <= down) if side > 0 else (high is not None and high >= down)
            if t or s:
                return ("SL" if s and (tie == "pessimistic" or not t) else "TP"), at
    return "OPEN", None


@pytest.mark.parametrize("horizon, chunk", [(7, None), (40, 10), (500, None)])
@pytest.mark.parametrize("tie", ["pessimistic", "optimistic"])
def test_first_touch_is_the_plain_loop(spark, horizon, chunk, tie):
    r = random.Random(horizon)
    minutes, entries, price = [], [], 100.0
    for k in range(400):
        price *= math.exp(r.gauss(0, 0.01))
        spread = abs(r.gauss(0, 0.01))
        for key in ("a", "b"):
            if r.random() < 0.9:
                minutes.append((key, k if r.random() < 0.95 else k - 1, None if r.random() < 0.02 else price * math.exp(spread), price * math.exp(-spread), len(minutes)))
    for i in range(300):
        entries.append((i, r.choice(["a", "b", "c", None]), r.choice([None, *range(-5, 410)]), r.choice([100.0, price, None]), r.choice([1, -1]), r.choice([0.01, 0.05, 0.2]), r.choice([0.01, 0.05])))
    m = spark.createDataFrame(minutes, "instrument string, open_time long, high double, low double, idx long").repartition(3)
    e = spark.createDataFrame(entries, "entry_id long, instrument string, ts long, price double, side int, tp double, sl double")
    got = {x.entry_id: (x.reason, x.exit_time) for x in broker.first_touch(e, m, horizon, tie, chunk_ms=chunk).collect()}
    assert got == {x[0]: plain(x, minutes, horizon, tie) for x in entries}
    assert {x.reason for x in broker.first_touch(e, m.limit(0), horizon).collect()} == {"OPEN"} and broker.first_touch(e.limit(0), m, horizon).count() == 0


def test_rows_read_do_not_grow_with_the_horizon():
    """Each entry looks at one stretch of rows for each power of two, whatever the horizon."""
    rng = np.random.default_rng(0)
    high = np.cumsum(rng.normal(size=10_000))
    extrema = broker.Extrema(high, high - 0.1)
    start = rng.integers(0, 9_000, 500)
    for horizon in (10, 1000):
        end = np.minimum(start + horizon, len(high))
        above, below = high[start] + 5, high[start] - 5
        got = extrema.first(start, end, above, below)
        for i in range(500):
            hit = np.flatnonzero((high[start[i] : end[i]] >= above[i]) | (high[start[i] : end[i]] - 0.1 <= below[i]))
            assert got[i] == (start[i] + hit[0] if len(hit) else end[i])
    assert len(extrema.tables) == 14


def test_order_rate_by_running_sums(spark):
    """Ties, null times and a null instrument; no frame of rows of the window, which takes time by the orders in it."""
    rng = np.random.default_rng(1)
    rows = [(["a", "b", None][i % 3], i, None if i % 17 == 0 else int(t)) for i, t in enumerate(rng.integers(0, 500, 400))]
    out = broker.order_rate(spark.createDataFrame(rows, "instrument string, id long, ts long"), "ts", 20, 3)
    got = {r.id: (r.recent, r.allowed) for r in out.collect()}
    for g, i, t in rows:
        n = sum(h == g and (u is None if t is None else u is not None and t - 20 <= u <= t) for h, _, u in rows)
        assert got[i] == (n, n <= 3)
    assert "RangeFrame" not in out._jdf.queryExecution().toString()
