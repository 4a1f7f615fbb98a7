"""Regimes: quantile edges and their assignment."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelorus.functions.metrics import quantiles
from pelorus.functions.scalars import null_if_nan


@dataclasses.dataclass(frozen=True)
class RegimeCuts:
    feature: str
    edges: tuple[float, ...]
    labels: tuple[str, ...]

    def assign(self) -> Column:
        """How many edges lie strictly below the value; null and NaN: 0."""
        v = null_if_nan(F.col(self.feature))
        below = sum((F.coalesce((v > e).cast("int"), F.lit(0)) for e in self.edges), F.lit(0))
        return below.cast("int")

    def label(self) -> Column:
        return F.element_at(F.array(*map(F.lit, self.labels)), self.assign() + 1)


def quantile_edges(df: DataFrame, feature: str, n: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles at 1/n, 2/n, ... of each group, as an array `edges`; null and NaN don't count."""
    values = df.select(*by, null_if_nan(F.col(feature)).alias("value"))
    return quantiles(values, "value", [k / n for k in range(1, n)], by).withColumnRenamed("quantiles", "edges")


def fit_cuts(df: DataFrame, feature: str, n: int = 3, labels: Sequence[str] | None = None) -> RegimeCuts:
    row = quantile_edges(df, feature, n).first()
    if row is None:
        raise ValueError(f"{feature} has no values to cut")
    names = tuple(labels or (("low", "med", "high") if n == 3 else tuple(f"q{k}" for k in range(n))))
    return RegimeCuts(feature, tuple(row.edges), names)


def volatility_terciles(df: DataFrame) -> RegimeCuts:
    return fit_cuts(df, "parkinson_var_rolling_mean_24")


def allowed(regime: str, regimes: Sequence[int]) -> Column:
    """Whether entries may happen: the regime is known and in the list."""
    return F.coalesce(F.col(regime).isin(*regimes), F.lit(False)) if regimes else F.lit(False)
