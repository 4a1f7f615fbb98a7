"""Streaming hosts: decision bars by event time, late rows, and the engine as a stateful processor."""

from __future__ import annotations

import dataclasses
import io
import json
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pelorus.operators.simulate import COMMANDS, SCHEMA, Engine, Position, SimConfig, bar_of, frame


def event_time(df: DataFrame, column: str = "open_time") -> DataFrame:
    """ts: the event time as a timestamp, which watermarks ask for."""
    return df.withColumn("ts", F.timestamp_millis(column))


def deduplicated(df: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First row of each instrument and open_time within the watermark; later ones are dropped."""
    return event_time(df).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["instrument", "open_time"])


def streaming_bars(minutes: DataFrame, m: int, delay: str = "10 minutes") -> DataFrame:
    """Bars of m minutes of the epoch, emitted when the watermark passes their end; takes static frames too.

    A frame that has ts already (after `deduplicated`) keeps the watermark that it has.
    """
    df = minutes if "ts" in minutes.columns else event_time(minutes)
    if df.isStreaming and "ts" not in minutes.columns:
        df = df.withWatermark("ts", delay)
    at = F.col("open_time")
    first, last = F.min(F.struct(at, "open")), F.max(F.struct(at, "close"))
    cell = F.struct(at, *(F.col(c) for c in ("high", "low", "close")))
    out = df.groupBy("instrument", F.window("ts", f"{m} minutes").alias("w")).agg(
        first["open"].alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last["close"].alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n"),
        F.first("segment_id").alias("segment_id"), F.sort_array(F.collect_list(cell)).alias("underlying"),
    )
    return out.select("instrument", F.unix_millis("w.start").alias("open_time"), "open", "high", "low", "close", "volume", "n", "segment_id", "underlying")


class EngineProcessor(StatefulProcessor):
    """The engine of one instrument; its whole state (positions, controller, forest) is in the state store."""

    def __init__(self, cfg: SimConfig):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("engine", "blob binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        engine = pickle.loads(self.state.get()[0]) if self.state.exists() else Engine(self.cfg)
        out: list[dict] = []
        for row in pd.concat(list(rows)).sort_values("open_time").to_dict("records"):
            out += engine.step(bar_of(row, self.cfg))
        self.state.update((pickle.dumps(engine),))
        yield frame(out, key[0])

    def close(self) -> None:
        pass


class _Pickler(pickle.Pickler):
    """The forest's trees share one generator: it is saved once, and parts name it."""

    def __init__(self, to: io.BytesIO, shared: object):
        super().__init__(to)
        self.shared = shared

    def persistent_id(self, obj: object) -> str | None:
        return "rng" if obj is self.shared else None


class _Unpickler(pickle.Unpickler):
    def __init__(self, of: io.BytesIO, shared: object):
        super().__init__(of)
        self.shared = shared

    def persistent_load(self, pid: str) -> object:
        return self.shared


def _blob(obj: object, shared: object) -> bytes:
    to = io.BytesIO()
    _Pickler(to, shared).dump(obj)
    return to.getvalue()


class OrderedEngineProcessor(StatefulProcessor):
    """The engine of one instrument by event time: bars and commands wait in the state until the watermark has passed them.

    held: rows that wait; positions: open ones, a row each; parts: the run's small remainder, the label that
    is to mature, and the trees of the forest. Of positions and parts only what a batch changed is written. One timer
    a key, at its earliest row that waits, starts the engine on all rows that the watermark has passed.
    """

    def __init__(self, cfg: SimConfig):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "at bigint, kind int, nth int", "row binary")
        self.positions = handle.getMapState("positions", "id bigint", POSITION)
        self.parts = handle.getMapState("parts", "name string", "blob binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            for row in part.to_dict("records"):
                at, command = int(row["open_time"]), row.get("command")
                told = isinstance(command, str)
                what = (command, row.get("args")) if told else bar_of(row, self.cfg)
                nth = 0
                while self.held.containsKey((at, int(not told), nth)):
                    nth += 1
                self.held.updateValue((at, int(not told), nth), (pickle.dumps(what),))
                first = at if first is None else min(first, at)
        if first is not None:
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(k) for k in self.held.keys())
        ready = [k for k in waiting if k[0] < upto]
        if ready:
            engine, saved, open_before = self._load()
            out: list[dict] = []
            for at, is_bar, nth in ready:
                what = pickle.loads(self.held.getValue((at, is_bar, nth))[0])
                self.held.removeKey((at, is_bar, nth))
                out += engine.step(what) if is_bar else command(engine, at, *what)
            self._save(engine, saved, open_before)
            yield frame(out, key[0])
        if len(ready) < len(waiting):  # the expired timer is deleted after this
            self.handle.registerTimer(waiting[len(ready)][0])

    def _wake(self, at: int) -> None:
        timers = list(self.handle.listTimers())
        if not timers or at < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def _load(self) -> tuple[Engine, dict[str, bytes], dict[int, tuple]]:
        saved = {k[0]: bytes(v[0]) for k, v in self.parts.iterator()}
        if not saved:
            return Engine(self.cfg), {}, {}
        engine = pickle.loads(saved["run"])
        engine.before = pickle.loads(saved["label"])
        if engine.model is not None:
            n = sum(name.startswith("tree") for name in saved)
            engine.model.members = [_Unpickler(io.BytesIO(saved[f"tree{i}"]), engine.model.rng).load() for i in range(n)]
        rows = {int(k[0]): tuple(v) for k, v in self.positions.iterator()}
        engine.broker.open = {i: Position(i, *rows[i]) for i in sorted(rows)}
        return engine, saved, rows

    def _save(self, engine: Engine, saved: dict[str, bytes], open_before: dict[int, tuple]) -> None:
        now = {i: dataclasses.astuple(p)[1:] for i, p in engine.broker.open.items()}
        for i in open_before.keys() - now.keys():
            self.positions.removeKey((i,))
        for i, p in now.items():
            if p != open_before.get(i):
                self.positions.updateValue((i,), p)
        parts = {"label": pickle.dumps(engine.before)}
        engine.broker.open, engine.before = {}, None
        if engine.model is not None:
            parts |= {f"tree{i}": _blob(m, engine.model.rng) for i, m in enumerate(engine.model.members)}
            engine.model.members = []
        parts["run"] = pickle.dumps(engine)
        for name, blob in parts.items():
            if blob != saved.get(name):
                self.parts.updateValue((name,), (blob,))

    def close(self) -> None:
        pass


POSITION = ", ".join(f"{f.name} {'bigint' if f.type == 'int' else 'double'}" for f in dataclasses.fields(Position)[1:])


def command(engine: Engine, at: int, name: str, args: str | None) -> list[dict]:
    """Run a command (args: a JSON list, or none) and log it; one that is unknown or fails is logged as rejected and changes nothing more."""
    try:
        COMMANDS[name](engine, *json.loads(args or "[]"))
    except Exception:  # an operator's slip doesn't stop the stream
        return [{"kind": "rejected", "ts": at * 1_000_000, "reason": f"command {name}"}]
    out = [{"kind": "command", "ts": at * 1_000_000, "reason": name}, *engine.broker.rows]
    engine.broker.rows = []
    return out


def addressed(commands: DataFrame, instruments: list[str]) -> DataFrame:
    """Commands without an instrument as one for each of the instruments."""
    all_ = F.array(*(F.lit(i) for i in instruments))
    return commands.withColumn("instrument", F.explode(F.when(F.col("instrument").isNull(), all_).otherwise(F.array("instrument"))))


def simulate_ordered(bars: DataFrame, cfg: SimConfig = SimConfig(), delay: str = "1 hour", commands: DataFrame | None = None) -> DataFrame:
    """The engine's outputs over a stream of bars that come in any order within `delay`; needs the RocksDB state store.

    A bar is taken once the watermark has passed its open_time, so outputs equal those of `simulate` over the same
    bars; one that comes after that is dropped. Bars of one time are taken in the order they came. commands
    (instrument, open_time, command, args) is a second stream: a command runs before the bars of its open_time,
    and gives a row of kind command (rejected, if it fails). Bars and commands share a watermark, so an idle
    stream of commands holds nothing back, and a command that is later than the delay is dropped. Rows with a null
    open_time never become due and are dropped.
    """
    rows = bars if commands is None else bars.unionByName(commands.select("instrument", "open_time", "command", F.col("args").cast("string").alias("args")), allowMissingColumns=True)
    timed = event_time(rows.where("open_time IS NOT NULL")).withWatermark("ts", delay)
    return timed.groupBy("instrument").transformWithStateInPandas(statefulProcessor=OrderedEngineProcessor(cfg), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")


def simulate_stream(bars: DataFrame, cfg: SimConfig = SimConfig()) -> DataFrame:
    """The engine's outputs over a stream of bars (with underlying); needs the RocksDB state store.

    Within a micro-batch bars are ordered by time; the source must not deliver a bar after a later one.
    """
    return bars.groupBy("instrument").transformWithStateInPandas(statefulProcessor=EngineProcessor(cfg), outputStructType=SCHEMA, outputMode="Append", timeMode="None")
