"""The engine's inputs built from the tables of a star schema and its event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.functions.scalars import epoch_ms, floor_div
from pelorus.operators.bars import time_bars
from pelorus.sources.minutes import with_segments

BAR_MINUTES = 240
GAP_MS = 7_200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a positive value as minute rows; one instrument for each event type, segments end at gaps over 2 h."""
    e = table(spark, sf_dir, "events").where("value > 0")
    volume = (1 + F.col("event_id") % 7).cast("double")
    taker = F.when(F.col("event_id") % 2 == 0, volume).otherwise(0.0)
    price = F.col("value")
    rows = e.select(
        F.col("event_type").alias("instrument"), F.col("event_id").alias("idx"), epoch_ms(F.col("ts")).alias("open_time"),
        *(price.alias(c) for c in ("open", "high", "low", "close")), volume.alias("volume"), (volume * price).alias("quote_volume"),
        F.lit(1).cast("long").alias("trades"), taker.alias("taker_buy_base"), (taker * price).alias("taker_buy_quote"),
    )
    return with_segments(rows, GAP_MS, ("open_time", "idx"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_bars(ticks(spark, sf_dir), BAR_MINUTES, ("open_time", "idx"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as predictions: idx, y (a purchase), p, regime by value."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("idx"), (F.col("event_type") == "purchase").cast("int").alias("y"), (1 / (1 + F.exp(-(v - 50) / 50))).alias("p"),
        ((v > 20).cast("int") + (v > 60).cast("int")).alias("regime"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as closed trades, one series for each order status: entry at the order's day, 1 to 10 days held."""
    days = F.col("o_orderkey") % 10 + 1
    entry = epoch_ms(F.col("o_orderdate")) * 1_000_000
    pnl = (F.log("o_totalprice") - F.log(F.lit(100_000.0))) / 100 - F.when(F.col("o_orderkey") % 3 == 0, 0.02).otherwise(0.0)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("idx"), F.col("o_orderstatus").alias("series"), entry.alias("entry_ts"), (entry + days * 86_400_000_000_000).alias("exit_ts"),
        F.when(F.col("o_orderkey") % 3 == 0, "SL").otherwise("TP").alias("reason"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1).alias("side"), pnl.alias("pnl"),
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades' day numbers: trade_id, n_open, n_close."""
    day = lambda c: floor_div(F.col(c), 86_400_000_000_000)
    return trades(spark, sf_dir).select(F.col("idx").alias("trade_id"), day("entry_ts").alias("n_open"), day("exit_ts").alias("n_close"))


def returns(spark: SparkSession, sf_dir: str, strategies: int = 5, every: int = 50) -> DataFrame:
    """Returns of strategies (user_id modulo 5) by period (each 50 events): the mean value, centred."""
    e = table(spark, sf_dir, "events")
    cells = e.groupBy((F.col("user_id") % strategies).cast("int").alias("strategy"), F.floor(F.col("event_id") / every).alias("period"))
    return cells.agg((F.avg("value") / 100 - 0.5).alias("r"))


def order_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ticks, one instrument for each supplier: many instruments for windows side by side."""
    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return li.select(
        F.col("l_suppkey").cast("string").alias("instrument"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("at"),
        epoch_ms(F.col("l_shipdate")).alias("open_time"), *(price.alias(c) for c in ("open", "high", "low", "close")), F.col("l_quantity").alias("volume"),
        F.col("l_extendedprice").alias("quote_volume"), F.lit(0).cast("long").alias("segment_id"),
    )
