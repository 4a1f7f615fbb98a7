"""Orders and positions that don't touch each other, as relations: costs, fills with latency, first touch, rates."""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelorus.functions import metrics


@dataclasses.dataclass(frozen=True)
class Costs:
    taker_bps: float = 1.0
    spread_bps: float = 0.0
    slippage_bps_per_unit: float = 0.0

    def per_side(self, size: Column | float = 1.0) -> Column | float:
        return (self.taker_bps + 0.5 * self.spread_bps + self.slippage_bps_per_unit * size) * 1e-4

    def round_trip(self, size: Column | float = 1.0) -> Column | float:
        return 2 * self.per_side(size) * size


def latency_fill(bars: DataFrame, latency: int = 1) -> DataFrame:
    """fill_price: the close of minute max(0, latency - 1) of the next bar. Bars need `underlying`."""
    w = Window.partitionBy("instrument").orderBy("open_time")
    at = F.get(F.lead("underlying").over(w), max(0, latency - 1))
    return bars.withColumn("fill_price", at["close"])


class Extrema:
    """Greatest highs and least lows of all stretches of 1, 2, 4, ... rows, by which the first row that reaches a barrier is found."""

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.tables = [(high, low)]
        while 2 << len(self.tables) - 1 <= len(high):
            step, (top, bottom) = 1 << len(self.tables) - 1, self.tables[-1]
            self.tables.append((np.maximum(top[:-step], top[step:]), np.minimum(bottom[:-step], bottom[step:])))

    def first(self, start: np.ndarray, end: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Of each entry the first row from start on with a high >= above or a low <= below; end if there is none before it."""
        at = start.copy()
        for k in range(len(self.tables) - 1, -1, -1):
            top, bottom = self.tables[k]
            whole = at + (1 << k) <= end
            spot = np.where(whole, at, 0)
            at += np.where(whole & ~(top[spot] >= above) & ~(bottom[spot] <= below), 1 << k, 0)
        return at


def _touches(entries: pa.Table, minutes: pa.Table, horizon_ms: int) -> pa.Table:
    """entries with the time, high and low of the first minute that reaches a barrier, of one instrument and chunk of time."""
    numbers = lambda table, c: table.column(c).to_numpy().astype(float)  # noqa: E731  null: NaN, which reaches nothing
    order = np.lexsort((minutes.column("m_idx").to_numpy(), minutes.column("m_time").to_numpy()))
    minutes = minutes.take(pa.array(order))
    time, high, low = minutes.column("m_time").to_numpy(), numbers(minutes, "m_high"), numbers(minutes, "m_low")
    ts, tp, sl, up = entries.column("ts").to_numpy(), numbers(entries, "tp_price"), numbers(entries, "sl_price"), numbers(entries, "side") > 0
    start, end = np.searchsorted(time, ts, "right"), np.searchsorted(time, ts + horizon_ms, "right")
    found = end
    if len(time):
        extrema = Extrema(np.where(np.isnan(high), -np.inf, high), np.where(np.isnan(low), np.inf, low))
        found = extrema.first(start, end, np.where(up, tp, sl), np.where(up, sl, tp))
    hit = pa.array(np.where(found < end, found, -1), mask=found >= end)
    columns = [minutes.column(c).take(hit) for c in ("m_time", "m_high", "m_low")]
    return pa.table([*entries.drop_columns(["chunk"]).columns, *columns], names=[*(c for c in entries.column_names if c != "chunk"), "m_time", "m_high", "m_low"])


def first_touch(entries: DataFrame, minutes: DataFrame, horizon_ms: int, tie: str = "pessimistic", costs: Costs = Costs(), chunk_ms: int | None = None) -> DataFrame:
    """The first minute within the horizon at which an entry's target or stop is reached.

    entries: entry_id, instrument, ts, price, side (1, -1), tp, sl (log returns); minutes: instrument,
    open_time, high, low (and idx to order equal times). Result: a row for each entry: reason (TP, SL or OPEN),
    exit_time, exit_price, pnl_gross, pnl_net. Nulls reach nothing, and an entry without instrument or ts stays OPEN.

    Entries and minutes meet by instrument and chunk of time (four horizons; a minute goes to the chunks whose entries it
    is in the horizon of, two at most), and an entry finds its minute in a hierarchy of extrema of the chunk's
    minutes. So rows grow with entries and minutes, and a longer horizon adds a step for each time it doubles.
    """
    size = chunk_ms or 4 * horizon_ms
    m = minutes.where("instrument IS NOT NULL AND open_time IS NOT NULL")
    m = m.select("instrument", F.col("open_time").cast("long").alias("m_time"), F.col("high").cast("double").alias("m_high"), F.col("low").cast("double").alias("m_low"), (F.col("idx").cast("long") if "idx" in m.columns else F.lit(0).cast("long")).alias("m_idx"))
    m = m.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("m_time") - horizon_ms) / size), F.floor((F.col("m_time") - 1) / size))))
    up = F.col("side") > 0
    e = entries.select("entry_id", "instrument", F.col("ts").cast("long").alias("ts"), "price", "side", "tp", "sl")
    e = e.withColumns({"tp_price": F.when(up, F.col("price") * F.exp("tp")).otherwise(F.col("price") * F.exp(-F.col("tp"))), "sl_price": F.when(up, F.col("price") * F.exp(-F.col("sl"))).otherwise(F.col("price") * F.exp("sl"))}).drop("tp", "sl")
    timed = e.where("ts IS NOT NULL").withColumn("chunk", F.floor(F.col("ts") / size))
    schema = T.StructType([*e.schema.fields, T.StructField("m_time", T.LongType()), T.StructField("m_high", T.DoubleType()), T.StructField("m_low", T.DoubleType())])
    near = timed.groupBy("instrument", "chunk").cogroup(m.groupBy("instrument", "chunk")).applyInArrow(lambda x, y: _touches(x, y, horizon_ms), schema)
    near = near.unionByName(e.where("ts IS NULL"), allowMissingColumns=True)
    tp = F.when(up, F.col("m_high") >= F.col("tp_price")).otherwise(F.col("m_low") <= F.col("tp_price"))
    sl = F.when(up, F.col("m_low") <= F.col("sl_price")).otherwise(F.col("m_high") >= F.col("sl_price"))
    if tie == "pessimistic":
        first = F.when(sl, "SL").otherwise("TP")
    elif tie == "optimistic":
        first = F.when(tp, "TP").otherwise("SL")
    else:  # a fair draw from the minute
        first = F.when(tp & sl, F.when(F.pmod(F.xxhash64("entry_id", "m_time"), F.lit(2)) == 0, "SL").otherwise("TP")).when(sl, "SL").otherwise("TP")
    reason = F.when(F.col("m_time").isNull(), "OPEN").otherwise(first)
    exit_price = F.when(reason == "TP", F.col("tp_price")).when(reason == "SL", F.col("sl_price"))
    gross = F.col("side") * F.log(exit_price / F.col("price"))
    return near.select("entry_id", "instrument", "ts", "price", "side", reason.alias("reason"), F.col("m_time").alias("exit_time"), exit_price.alias("exit_price"), gross.alias("pnl_gross"), (gross - costs.round_trip()).alias("pnl_net"))


def first_touch_in(underlying: str, entry: Column, tp: float, sl: float, side: int = 1) -> Column:
    """The first minute of an array that reaches a barrier (stop first): struct(ts, reason, price), or null."""
    t, s = (entry * F.exp(F.lit(side * tp)), entry * F.exp(F.lit(-side * sl)))
    hit_t = (lambda x: x["high"] >= t) if side > 0 else (lambda x: x["low"] <= t)
    hit_s = (lambda x: x["low"] <= s) if side > 0 else (lambda x: x["high"] >= s)
    first = F.get(F.filter(underlying, lambda x: hit_t(x) | hit_s(x)), 0)
    return F.when(first.isNotNull(), F.struct(first["open_time"].alias("ts"), F.when(hit_s(first), "SL").otherwise("TP").alias("reason"), F.when(hit_s(first), s).otherwise(t).alias("price")))


def order_rate(orders: DataFrame, ts_ms: str = "ts", window_ms: int = 60_000, most: int = 10, by: str = "instrument") -> DataFrame:
    """recent: orders in the last window (this one included), and allowed while they are at most `most`.

    Orders up to a time less those before its window: both are running sums over distinct times and their windows' starts, in
    buckets of a window's length, so the work for an order doesn't grow with the orders of its window. Null times are a window.
    """
    times = orders.groupBy(by, F.col(ts_ms).alias("__ts")).agg(F.count("*").alias("__n"))
    end = F.struct(F.col("__ts").alias("at"), F.lit(1).alias("kind"), "__ts", "__n")
    start = F.struct((F.col("__ts") - window_ms).alias("at"), F.lit(0).alias("kind"), "__ts", F.lit(0).cast("long").alias("__n"))
    points = times.where("__ts IS NOT NULL").select(by, F.explode(F.array(end, start)).alias("__p")).select(by, "__p.*")
    points = points.withColumn("__order", F.struct("at", "kind"))
    sums = metrics.running(points, [by], "__order", {"__before": "__n"}, F.floor(F.col("at") / max(1, window_ms)))
    signed = F.when(F.col("kind") == 1, F.col("__before") + F.col("__n")).otherwise(-F.col("__before"))
    found = sums.groupBy(by, "__ts").agg(F.sum(signed).alias("recent"))
    found = found.union(times.where("__ts IS NULL").select(by, "__ts", "__n")).withColumnRenamed("__ts", ts_ms)
    return metrics.join_by(orders, found, [by, ts_ms]).withColumn("allowed", F.col("recent") <= most)


def gate(p: str = "p", tau: float = 0.5, k: float = 5.0) -> dict[str, Column]:
    """enter (threshold gate) and size (calibrated by the margin)."""
    size = F.greatest(F.lit(0.0), F.least(F.lit(1.0), k * (F.col(p) - tau)))
    return {"enter": F.col(p) >= tau, "size": F.when(F.col(p) > tau, size).otherwise(0.0)}


def portfolio(positions: DataFrame) -> DataFrame:
    """Per instrument: open positions, net signed size, unrealized pnl, winners and losers."""
    return positions.groupBy("instrument").agg(
        F.count("*").alias("n_open"), F.sum(F.col("side") * F.col("size")).alias("net_signed"), F.sum("unrealized").alias("unrealized"),
        F.count_if(F.col("unrealized") > 0).alias("winners"), F.count_if(F.col("unrealized") <= 0).alias("losers"),
    )


def excursions(marks: DataFrame) -> DataFrame:
    """Mark-to-market of independent positions (entry_id, side, price, size, open_time, close): unrealized, MAE and MFE so far."""
    w = Window.partitionBy("entry_id").orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0)
    out = marks.withColumn("unrealized", F.col("side") * F.log(F.col("close") / F.col("price")) * F.col("size"))
    return out.withColumns({"mae": F.least(F.lit(0.0), F.min("unrealized").over(w)), "mfe": F.greatest(F.lit(0.0), F.max("unrealized").over(w))})
