"""Decision bars from minute rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A step of more than this many milliseconds between rows ends a chunk.
GAP_MS = 61_000
SUMS = ("volume", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote")


def _ohlc(order: Column) -> list[Column]:
    """min and max of a struct keep one buffer each and combine before the shuffle."""
    first, last = F.min(F.struct(order.alias("o"), F.col("open").alias("v"))), F.max(F.struct(order.alias("o"), F.col("close").alias("v")))
    return [first["v"].alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last["v"].alias("close")]


def count_bars(minutes: DataFrame, m: int, gap_ms: int = GAP_MS, order: tuple[str, ...] = ("open_time",), underlying: bool = True) -> DataFrame:
    """One bar for each m rows without a gap or change of segment between; incomplete tails go.

    Adds run and chunk numbers, duration_ms, and with `underlying` the rows themselves in order.
    """
    w = Window.partitionBy("instrument").orderBy(*order)
    step = F.col("open_time") - F.lag("open_time").over(w)
    breaks = F.coalesce(((step > gap_ms) | (F.col("segment_id") != F.lag("segment_id").over(w))).cast("long"), F.lit(0))
    rows = minutes.withColumn("__break", breaks).withColumn("run", F.sum("__break").over(w))
    rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("instrument", "run").orderBy(*order)))
    rows = rows.withColumn("chunk", F.floor((F.col("__nth") - 1) / m))
    sums = [F.sum(c).alias(c) for c in SUMS if c in minutes.columns]
    kept = [F.sort_array(F.collect_list(F.struct(*(F.col(c) for c in dict.fromkeys((*order, "open_time", "open", "high", "low", "close")))))).alias("underlying")] if underlying else []
    bars = rows.groupBy("instrument", "run", "chunk").agg(
        F.count("*").alias("n"), F.min("open_time").alias("open_time"), *_ohlc(F.col("__nth")), *sums, F.first("segment_id").alias("segment_id"), *kept
    )
    return bars.where(F.col("n") == m).withColumn("duration_ms", F.lit(m * 60_000).cast("long"))


def time_bars(minutes: DataFrame, m: int, order: tuple[str, ...] = ("open_time",)) -> DataFrame:
    """One bar for each m minutes of the epoch that have rows; partial bars stay and gaps don't matter."""
    width = m * 60_000
    seg = F.col("segment_id") if "segment_id" in minutes.columns else F.lit(0).cast("long")
    sums = [F.sum(c).alias(c) for c in SUMS if c in minutes.columns]
    at = F.struct(*order)
    keyed = minutes.withColumns({"__bar": F.floor(F.col("open_time") / width) * width, "__seg": seg})
    out = keyed.groupBy("instrument", "__bar").agg(*_ohlc(at), *sums, F.min(F.struct(at.alias("o"), F.col("__seg").alias("v")))["v"].alias("segment_id"))
    return out.withColumnRenamed("__bar", "open_time")
