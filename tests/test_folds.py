"""Folds take their part of runs that are made once for each start."""

import pytest
from pyspark.sql import functions as F

from pelorus.operators import features, simulate
from pelorus.operators.bars import count_bars
from pelorus.plans import experiment, search
from pelorus.plans.config import CVConfig
from pelorus.sources import minutes

CFG = simulate.SimConfig(tp=0.002, sl=0.002, policies=(), inventory_cap=2, params=(("tau", 0.3),), learn=True, features=("parkinson_vol",))


@pytest.fixture(scope="module")
def bars(spark, tmp_path_factory):
    rows = minutes.synthetic(spark, 1600, instruments=2, sigma=0.002)
    path = str(tmp_path_factory.mktemp("bars"))
    df = features.base_features(count_bars(rows, 20)).where("instrument IS NOT NULL").withColumns({"p": F.lit(0.9), "regime": F.lit(0)})
    df.select("instrument", "open_time", "high", "close", "segment_id", "underlying", "p", "regime", "parkinson_vol").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).withColumn("__row", F.row_number().over(features.by_time()) - 1)


@pytest.mark.parametrize("between", [True, False])
def test_folds_are_runs_of_their_own(spark, bars, between):
    n = bars.agg(F.max("__row")).first()[0] + 1
    cv = CVConfig(n_folds=5, n_test=2, between=between)
    got = sorted(map(tuple, experiment.fold_fills(spark, bars, n, cv, CFG).select("split", "idx", "entry_ts", "exit_ts", "reason", "pnl").collect()))
    of = {}
    for r in sorted((r.asDict(recursive=True) for r in bars.collect()), key=lambda r: r["open_time"]):
        of.setdefault(r["instrument"], []).append(r)
    tests = {}
    for r in search.purged_folds(spark, n, 5, 2).where("kind = 'test'").collect():
        tests.setdefault(r.split, []).append((r["first"], r.behind))
    want = []
    for split, blocks in tests.items():
        for a, b in [(min(x for x, _ in blocks), max(y for _, y in blocks))] if between else blocks:
            for rows in of.values():
                engine = simulate.Engine(CFG)
                for row in rows[a:b]:
                    want += [(split, f["position_id"], f["entry_ts"], f["exit_ts"], f["reason"], f["pnl_net"]) for f in engine.step(simulate.bar_of(row, CFG)) if f["kind"] == "fill"]
    assert len(want) > 50 and got == sorted(want)
    if not between:  # all trades lie within a test block
        edges = {(name, k): rows[k]["open_time"] * 1_000_000 for name, rows in of.items() for k in range(len(rows))}
        first = next(iter(of))
        for split, _, entry, leave, _, _ in got:
            assert any(edges[first, a] <= entry and (b == n or leave < edges[first, b]) for a, b in tests[split])


def test_few_rows_give_no_folds(spark, bars):
    assert experiment.fold_fills(spark, bars.limit(0), 0, CVConfig(n_folds=5, n_test=2), CFG).count() == 0
    assert experiment.fold_fills(spark, bars.where("__row < 3"), 3, CVConfig(n_folds=5, n_test=2), CFG).count() >= 0


def test_runs_are_one_for_each_start(spark, bars, monkeypatch):
    seen = []
    replay = simulate.replay
    monkeypatch.setattr(simulate, "replay", lambda near, *args: seen.append(near.count()) or replay(near, *args))
    n = bars.agg(F.max("__row")).first()[0] + 1
    experiment.fold_fills(spark, bars, n, CVConfig(n_folds=5, n_test=2), CFG)
    experiment.fold_fills(spark, bars, n, CVConfig(n_folds=5, n_test=2, between=False), CFG)
    total = bars.count()
    spans = total // 5 * sum(b - a + 1 for a in range(5) for b in range(a + 1, 5))
    assert seen[0] == total // 5 * (5 + 4 + 3 + 2) < spans and seen[1] == total
