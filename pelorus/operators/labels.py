"""Labels by the next bar, splits and sample weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelorus.functions.metrics import quantiles
from pelorus.operators.features import by_time

DEFAULT_ALPHA = 0.0041113


def excursion(high: str = "high", close: str = "close") -> Column:
    """ln(next high / close), null at the end of a segment."""
    same = F.lead("segment_id").over(by_time()) == F.col("segment_id")
    return F.when(same & (F.col(close) > 0) & (F.lead(high).over(by_time()) > 0), F.log(F.lead(high).over(by_time()) / F.col(close)))


def log_excursion() -> Column:
    """The same from columns that are logarithms already."""
    same = F.lead("segment_id").over(by_time()) == F.col("segment_id")
    return F.when(same, F.lead("log_high").over(by_time()) - F.col("log_close"))


def numbered(df: DataFrame) -> DataFrame:
    """nth (from 1, by time) and n of each instrument."""
    whole = Window.partitionBy("instrument")
    return df.withColumns({"nth": F.row_number().over(by_time()), "n": F.count("*").over(whole)})


def alpha(df: DataFrame, train_fraction: float = 0.6, quantile: float = 0.9) -> DataFrame:
    """Per instrument: the quantile of log_excursion over the first int(n * fraction) rows. Needs log_excursion."""
    train = numbered(df).where(F.col("nth") <= F.floor(F.col("n") * train_fraction))
    known = quantiles(train, "log_excursion", [quantile], ["instrument"]).select("instrument", F.col("quantiles")[0].alias("alpha"))
    return train.select("instrument").distinct().join(known, "instrument", "left")


def labels(bars: DataFrame, alpha_value: float | None = None, train_fraction: float = 0.6, quantile: float = 0.9) -> DataFrame:
    """bars with log_excursion, alpha and label (1 if the excursion reaches alpha; null without one)."""
    df = bars.withColumn("log_excursion", excursion())
    if alpha_value is None:
        df = df.join(alpha(df, train_fraction, quantile), "instrument", "left")
    else:
        df = df.withColumn("alpha", F.lit(alpha_value))
    return df.withColumn("label", F.when(F.col("log_excursion").isNotNull(), (F.col("log_excursion") >= F.col("alpha")).cast("int")))


def chronological_split(df: DataFrame, fraction: float = 0.8) -> DataFrame:
    """is_train: the first int(n * fraction) rows of an instrument."""
    return numbered(df).withColumn("is_train", F.col("nth") <= F.floor(F.col("n") * fraction)).drop("nth", "n")


def asymmetric_weights(df: DataFrame, phi: float, w_max: float = 5.0, q_tail: float = 0.001, use_positive: bool = False, m: str = "log_excursion", label: str = "label", flat: float = 1.0) -> DataFrame:
    """weight: near misses among negatives weigh up to w_max, positives 1.

    Distance d = max(0, phi - m), cut at its (1 - q_tail) quantile d* among negatives (per instrument);
    weight exp(min(lambda d, ln w_max)) with lambda = ln(w_max) / d*. Where d* is 0 negatives weigh `flat`: 1, or w_max
    if a distance that reaches d* is to have the most weight there too.
    """
    d = F.greatest(F.lit(0.0), F.lit(phi) - F.col(m))
    df = df.withColumn("__d", d)
    star = quantiles(df.where(F.col(label) == 0), "__d", [1 - q_tail], ["instrument"]).select("instrument", F.col("quantiles")[0].alias("__star"))
    rate = math.log(w_max) / F.col("__star")
    grown = F.when(F.col("__star") > 0, F.exp(F.least(rate * F.col("__d"), F.lit(math.log(w_max))))).otherwise(float(flat))
    positive = F.when(F.col("__star") > 0, F.exp(F.least(rate * F.greatest(F.lit(0.0), F.col(m) - F.lit(phi)), F.lit(math.log(w_max))))).otherwise(1.0) if use_positive else F.lit(1.0)
    return df.join(star, "instrument", "left").withColumn("weight", F.when(F.col(label) == 0, grown).when(F.col(label) == 1, positive)).drop("__d", "__star")


def effective_n(weight: str = "weight") -> Column:
    return F.sum(weight) * F.sum(weight) / F.sum(F.col(weight) * F.col(weight))
