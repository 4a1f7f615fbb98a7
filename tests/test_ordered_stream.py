"""The engine as keyed state: bars out of order and a stream of commands."""

import os
import random

from pyspark.sql import functions as F

from pelorus.operators import features, simulate
from pelorus.operators.bars import count_bars
from pelorus.plans.pipeline import table_hash
from pelorus.sources import minutes
from pelorus.streaming import processor

CFG = simulate.SimConfig(tp=0.004, sl=0.004, policies=(), inventory_cap=3, learn=True, features=("v", "parkinson_vol"), params=(("tau", 0.3),))
COLUMNS = ["instrument", "open_time", "high", "close", "segment_id", "underlying", "p", "regime", "v", "parkinson_vol"]


def made_bars(spark, tmp_path):
    rows = minutes.synthetic(spark, 1200, instruments=2, sigma=0.002)
    df = features.build(features.base_features(count_bars(rows, 20)), [features.FeatureSpec("v", "parkinson_vol", "mean", 4)])
    df.withColumns({"p": F.lit(0.9), "regime": F.lit(0)}).select(COLUMNS).write.parquet(f"{tmp_path}/bars")
    return spark.read.parquet(f"{tmp_path}/bars")


def in_files(spark, df, rows, path, per):
    """Rows in the order given, `per` to a file, file after file; the last one is far in the future, for the watermark."""
    last = rows[-1].asDict() | {"instrument": "end", "open_time": max(r.open_time for r in rows) + 10**9}
    rows = [tuple(r) for r in rows] + [tuple(last.values())]
    for k, i in enumerate(range(0, len(rows), per)):
        spark.createDataFrame(rows[i : i + per], df.schema).coalesce(1).write.parquet(f"{path}/{k:03d}")
        for n in os.listdir(f"{path}/{k:03d}"):
            os.utime(f"{path}/{k:03d}/{n}", (1_700_000_000 + 100 * k,) * 2)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def run(out, name, tmp_path):
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/state-{name}").trigger(availableNow=True).start()
    q.awaitTermination(240)
    return out.sparkSession.table(name)


def test_out_of_order_is_batch(spark, tmp_path):
    df = made_bars(spark, tmp_path)
    rng = random.Random(5)
    rows = sorted(df.collect(), key=lambda r: r.open_time + rng.randint(0, 3 * 3_600_000))
    assert any(a.open_time > b.open_time for a, b in zip(rows, rows[1:]))
    got = run(processor.simulate_ordered(in_files(spark, df, rows, f"{tmp_path}/in", 30), CFG, "4 hours"), "ordered", tmp_path).where("instrument <> 'end'")
    want = simulate.simulate(df, CFG)
    assert want.where("kind = 'fill'").count() > 5 and got.count() == want.count()
    assert table_hash(got) == table_hash(want)


def test_commands_are_a_stream(spark, tmp_path):
    df = made_bars(spark, tmp_path)
    rows = sorted(df.collect(), key=lambda r: (r.open_time, r.instrument))
    times = sorted({r.open_time for r in rows})
    names = sorted({r.instrument for r in rows})
    told = [(None, times[10], "pause", None), (names[0], times[20], "resume", "[]"), (names[1], times[25], "flatten", None), (names[1], times[26], "resume", None), (names[0], times[30], "no such", None), (names[0], times[40], "risk_add", '["kill_switch", true]')]
    schema = "instrument string, open_time long, command string, args string"
    commands = spark.createDataFrame(told, schema)
    commands.coalesce(1).write.parquet(f"{tmp_path}/told")
    stream = processor.addressed(spark.readStream.schema(schema).parquet(f"{tmp_path}/told"), names)
    got = run(processor.simulate_ordered(in_files(spark, df, rows, f"{tmp_path}/in", 200), CFG, "40 hours", stream), "told", tmp_path).where("instrument <> 'end'")

    want = []
    for name in names:
        engine, out = simulate.Engine(CFG), []
        todo = [(t, 0, (c, a)) for i, t, c, a in told if i in (None, name)] + [(r.open_time, 1, r) for r in rows if r.instrument == name]
        for at, is_bar, what in sorted(todo, key=lambda x: x[:2]):
            if is_bar:
                out += engine.step(simulate.bar_of(what.asDict(recursive=True), CFG))
            else:
                out += processor.command(engine, at, *what)
        want += [(name, r["kind"], r["ts"], r.get("reason"), r.get("position_id"), r.get("equity"), r.get("paused")) for r in out]
    have = [(r.instrument, r.kind, r.ts, r.reason, r.position_id, r.equity, r.paused) for r in got.collect()]
    assert sorted(map(str, have)) == sorted(map(str, want))
    assert [r.reason for r in got.where(f"kind = 'command' AND instrument = '{names[0]}'").orderBy("ts").collect()] == ["pause", "resume", "risk_add"]
    assert got.where("reason = 'command no such' AND kind = 'rejected'").count() == 1
