"""Minute rows: scan, range, validation, cleansing, synthetic data, sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelorus.functions import scalars as S
from pelorus.sources import files

PRICES = ("open", "high", "low", "close")
SCHEMA = T.StructType(
    [T.StructField("open_time", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in (*PRICES, "volume")]
    + [T.StructField("close_time", T.LongType()), T.StructField("quote_volume", T.DoubleType()), T.StructField("trades", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("taker_buy_base", "taker_buy_quote")]
    + [T.StructField("segment_id", T.LongType())]
)
REQUIRED = tuple(f.name for f in SCHEMA.fields)
DEFAULT_INSTRUMENT = S.instrument("BTCUSDT")


def conform(df: DataFrame, instrument: str = DEFAULT_INSTRUMENT) -> DataFrame:
    """The required columns, cast, and the instrument; other columns go. Raises if one lacks."""
    if lacking := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"minute rows lack {', '.join(lacking)}")
    key = F.col("instrument") if "instrument" in df.columns else F.lit(instrument)
    return df.select(key.alias("instrument"), *(F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMA.fields))


def read_minutes(spark: SparkSession, path: str, start_ms: int | None = None, end_ms: int | None = None, instrument: str = DEFAULT_INSTRUMENT) -> DataFrame:
    return time_range(conform(spark.read.parquet(path), instrument), start_ms, end_ms)


def stream_minutes(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A file stream of minute rows under the fixed schema."""
    reader = spark.readStream.schema(SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return conform(reader.parquet(path))


def time_range(df: DataFrame, start_ms: int | None = None, end_ms: int | None = None, column: str = "open_time") -> DataFrame:
    """Inclusive at both ends; reaches the parquet scan as a pushed filter."""
    if start_ms is not None:
        df = df.where(F.col(column) >= start_ms)
    return df if end_ms is None else df.where(F.col(column) <= end_ms)


def valid_rows(df: DataFrame) -> DataFrame:
    """Rows with finite prices above 0 and a finite volume of at least 0; a row left out makes a gap."""
    ok = S.is_quantity(F.col("volume"))
    for c in PRICES:
        ok &= S.is_price(F.col(c))
    return df.where(ok)


def cleanse(df: DataFrame, gap_ms: int = 61_000) -> DataFrame:
    """Microseconds to milliseconds, one row for an open_time (the first by close_time), segments by gaps."""
    ms = lambda c: F.when(F.col(c) > 100_000_000_000_000, F.floor(F.col(c) / 1000)).otherwise(F.col(c)).cast("long")
    df = df.withColumns({"open_time": ms("open_time"), "close_time": ms("close_time")})
    first = Window.partitionBy("instrument", "open_time").orderBy("close_time", *PRICES)
    df = df.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")
    return with_segments(df, gap_ms)


def with_segments(df: DataFrame, gap_ms: int, order: tuple[str, ...] = ("open_time",)) -> DataFrame:
    """segment_id: how many gaps of more than gap_ms the instrument had before."""
    w = Window.partitionBy("instrument").orderBy(*order)
    gap = F.coalesce((F.col("open_time") - F.lag("open_time").over(w) > gap_ms).cast("long"), F.lit(0))
    return df.withColumn("__gap", gap).withColumn("segment_id", F.sum("__gap").over(w)).drop("__gap")


def synthetic(spark: SparkSession, n: int = 129_600, seed: int = 42, sigma: float = 0.0008, start_ms: int = 1_700_000_000_000, instruments: int = 1) -> DataFrame:
    """Seeded log random walks of minute rows, one for each instrument."""
    unit = lambda k: (F.pmod(F.xxhash64("i", "k", F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = lambda k: F.sqrt(-2 * F.log(unit(k))) * F.cos(2 * 3.141592653589793 * unit(k + 100))
    w = Window.partitionBy("k").orderBy("i")
    rows = spark.range(n * instruments).select((F.col("id") % n).alias("i"), F.floor(F.col("id") / n).alias("k"))
    rows = rows.withColumn("step", F.when(F.col("i") == 0, 0.0).otherwise(sigma * normal(1)))
    rows = rows.withColumn("c", F.exp(10 + F.sum("step").over(w)))
    rows = rows.withColumn("o", F.coalesce(F.lag("c").over(w), F.col("c")))
    volume = F.round(F.abs(100 + 20 * normal(2)), 4)
    close = F.round("c", 4)
    return rows.select(
        F.concat(F.lit("S"), F.col("k").cast("string"), F.lit("@synthetic")).alias("instrument"),
        (F.lit(start_ms) + 60_000 * F.col("i")).alias("open_time"),
        F.round("o", 4).alias("open"),
        F.round(F.col("c") * (1 + F.abs(1.2 * sigma * normal(3))), 4).alias("high"),
        F.round(F.col("c") * (1 - F.abs(1.2 * sigma * normal(4))), 4).alias("low"),
        close.alias("close"),
        volume.alias("volume"),
        (F.lit(start_ms) + 60_000 * F.col("i") + 59_999).alias("close_time"),
        (volume * close).alias("quote_volume"),
        F.lit(50).cast("long").alias("trades"),
        (volume / 2).alias("taker_buy_base"),
        (volume * close / 2).alias("taker_buy_quote"),
        F.lit(0).cast("long").alias("segment_id"),
    )


def write(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_json(value: object, path: str) -> None:
    files.write(path, json.dumps(value, indent=2, sort_keys=True, default=str).encode())


def read_importance(path: str) -> dict[str, float]:
    """Feature importances: a JSON object, a JSON list of {name, score}, or lines `name score` with # comments."""
    text = files.read(path).decode()
    try:
        found = json.loads(text)
    except ValueError:
        lines = (line.split("#")[0].split() for line in text.splitlines())
        return {x[0]: float(x[1]) for x in lines if len(x) >= 2}
    return {k: float(v) for k, v in found.items()} if isinstance(found, dict) else {x["name"]: float(x["score"]) for x in found}
