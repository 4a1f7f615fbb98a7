"""Features of bars that look back only: base columns, rolling statistics, lags, the catalog."""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelorus.functions import kernels
from pelorus.operators import incremental


def by_time():
    return Window.partitionBy("instrument").orderBy("open_time")


# Windows, lags and columns of the catalog, by which importance files and trained models name features.
WINDOWS = (1, 2, 4, 8, 12, 24, 48, 96)
LAGS = (1, 2, 3, 5, 10)
SOURCES = (
    "return", "abs_return", "squared_return", "range_pct",
    "parkinson_var", "garman_klass_var", "log_volume",
    "log_quote_volume", "log_trades", "range_hl",
    "close_to_vwap", "imbalance", "buy_ratio",
)
LAGGED = ("return", "abs_return", "range_hl", "log_volume", "buy_ratio", "imbalance")
CALENDAR = ("minute_sin", "minute_cos", "dow_sin", "dow_cos")
#: Values of the windows of the kernels.
KERNEL_WINDOW = 128


def _c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def ratio(a: Column, b: Column, default: float | Column = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(default)


def base_features(bars: DataFrame) -> DataFrame:
    """Single-bar and previous-bar columns. Returns need the previous bar in the same segment (else 0.0); true range doesn't."""
    o, h, lo, c, v, qv, n, tbb, tbq = _c("open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote")
    log = lambda x: F.when(x > 0, F.log(x))
    prev = F.lag("close").over(by_time())
    linked = (prev > 0) & (F.lag("segment_id").over(by_time()) == F.col("segment_id"))
    moved = lambda x: F.coalesce(F.when(linked & (x > 0), F.log(x / prev)), F.lit(0.0))
    df = bars.withColumns({"__prev": prev, "return": moved(c), "open_gap_return": moved(o)})
    hl, r, prev = F.log(h / lo), F.col("return"), F.col("__prev")
    ok = (h > 0) & (lo > 0)
    park = F.when(ok & (h >= lo), hl * hl / (4 * math.log(2))).otherwise(0.0)
    gk = F.when(ok & (o > 0) & (c > 0), 0.5 * hl * hl - (2 * math.log(2) - 1) * F.log(c / o) * F.log(c / o)).otherwise(0.0)
    vwap = F.when((v > 0) & (qv > 0), qv / v).otherwise(c)
    imbalance = ratio(2 * tbb - v, v)
    lv = F.when(v > 0, F.log1p(v))
    minute = (F.floor(F.col("open_time") / 60_000) % 1440).cast("double")
    dow = ((F.floor(F.col("open_time") / 86_400_000) + 4) % 7).cast("double")
    turn = lambda f, x, n: F.when(F.col("open_time") > 0, f(2 * math.pi * x / n)).otherwise(0.0)
    return df.withColumns(
        {
            "log_open": log(o), "log_high": log(h), "log_low": log(lo), "log_close": log(c),
            "log_volume": lv, "log_quote_volume": F.log1p(qv), "log_trades": F.log1p(n.cast("double")),
            "range_hl": h - lo, "range_pct": ratio(h - lo, c), "body": c - o, "body_abs": F.abs(c - o),
            "upper_wick": h - F.greatest(o, c), "lower_wick": F.least(o, c) - lo,
            "abs_return": F.abs(r), "squared_return": r * r,
            "parkinson_var": park, "parkinson_vol": F.sqrt(F.greatest(park, F.lit(0.0))),
            "garman_klass_var": gk, "garman_klass_vol": F.sqrt(F.greatest(gk, F.lit(0.0))),
            "true_range": F.when(prev.isNull(), h - lo).otherwise(F.greatest(h - lo, F.abs(h - prev), F.abs(lo - prev))),
            "close_position": ratio(c - lo, h - lo, 0.5), "open_position": ratio(o - lo, h - lo, 0.5),
            "oc_return": F.when((o > 0) & (c > 0), F.log(c / o)).otherwise(0.0),
            "vwap": vwap, "vwap_log": F.when(vwap > 0, F.log(vwap)), "close_to_vwap": F.when(vwap > 0, (c - vwap) / vwap).otherwise(0.0),
            "buy_ratio": ratio(tbb, v, 0.5), "imbalance": imbalance, "buy_ratio_quote": ratio(tbq, qv, 0.5),
            "avg_trade_size": ratio(v, n), "return_x_log_volume": r * F.coalesce(lv, F.lit(0.0)), "return_x_imbalance": r * imbalance,
            "range_x_log_volume": (h - lo) * F.coalesce(lv, F.lit(0.0)), "illiq": F.when((F.abs(r) > 0) & (qv > 0), F.abs(r) / qv).otherwise(0.0),
            "minute_sin": turn(F.sin, minute, 1440), "minute_cos": turn(F.cos, minute, 1440), "dow_sin": turn(F.sin, dow, 7), "dow_cos": turn(F.cos, dow, 7),
        }
    ).drop("__prev")


def edge_flags(bars: DataFrame) -> DataFrame:
    """first_bar, segment_start, range_zero, no_trades, no_volume, gk_negative; and body_fraction, expanding_mean_return."""
    before = F.lag("segment_id").over(by_time())
    past = by_time().rowsBetween(Window.unboundedPreceding, -1)
    df = base_features(bars)
    return df.withColumns(
        {
            "first_bar": F.row_number().over(by_time()) == 1,
            "segment_start": F.coalesce(before != F.col("segment_id"), F.lit(True)),
            "range_zero": F.col("high") == F.col("low"),
            "no_trades": F.col("trades") == 0,
            "no_volume": F.col("volume") == 0,
            "gk_negative": F.col("garman_klass_var") < 0,
            "body_fraction": F.col("body_abs") / (F.col("range_hl") + 1e-12),
            "expanding_mean_return": F.avg("return").over(past),
        }
    )


@dataclasses.dataclass(frozen=True)
class FeatureSpec:
    """A feature of the last `window` values that end `lag` values ago."""

    name: str
    source: str
    stat: str
    window: int = 1
    lag: int = 1
    forecasting_safe: bool = True

    def __post_init__(self):
        if self.lag < 0 or (self.lag < 1 and self.forecasting_safe):
            raise ValueError(f"{self.name}: a feature that is safe for forecasting has a lag of 1 or more")
        if self.window < 1:
            raise ValueError(f"{self.name}: the window must have a value")
        if self.stat not in {*STATS, *KERNELS, "lag", "identity"}:
            raise ValueError(f"{self.name}: no statistic {self.stat}")

    @property
    def update_samples(self) -> int:
        return self.lag + self.window


def _iqr(src: Column, w) -> Column:
    """Nearest-rank interquartile range; null below four values."""
    s = F.sort_array(F.collect_list(src).over(w))
    n = F.size(s)
    return F.when(n >= 4, F.get(s, F.least(n - 1, F.floor(n * 0.75)).cast("int")) - F.get(s, F.floor(n * 0.25).cast("int")))


#: Rolling statistics: a function of the source column and the window.
STATS: dict[str, Callable] = {
    "mean": lambda x, w: F.avg(x).over(w),
    "var": lambda x, w: F.when(F.count(x).over(w) > 1, F.var_samp(x).over(w)).otherwise(0.0),
    "min": lambda x, w: F.min(x).over(w),
    "max": lambda x, w: F.max(x).over(w),
    "ptp": lambda x, w: F.max(x).over(w) - F.min(x).over(w),
    "iqr": _iqr,
}


BUILT_IN = dict(STATS)
#: Rolling statistics that are made in one pass over Arrow batches, where there are so many; fewer are window functions.
MANY = 32
#: Kernels over the last values of a column, across segments.
KERNELS: dict[str, kernels.Kernel] = {"hurst": kernels.hurst, "sample_entropy": kernels.sample_entropy}


def register_stat(name: str, make: Callable) -> None:
    """Add a rolling statistic: make(source column, window) -> column."""
    STATS[name] = make


def with_runs(df: DataFrame) -> DataFrame:
    """seg_run: number of changes of segment_id so far, so a segment id that returns is a new run."""
    change = F.coalesce((F.col("segment_id") != F.lag("segment_id").over(by_time())).cast("long"), F.lit(0))
    return df.withColumn("__change", change).withColumn("seg_run", F.sum("__change").over(by_time())).drop("__change")


def rolling(source: str, stat: str, window: int, lag: int = 1) -> Column:
    """Statistic of the `window` most recent non-null values that end `lag` values before this row's, in its run of a segment.

    Null where the source is null or the run has had too few values. Needs seg_run.
    """
    src = F.col(source)
    own = Window.partitionBy("instrument", "seg_run", src.isNotNull()).orderBy("open_time")
    enough = src.isNotNull() & (F.row_number().over(own) >= lag + window)
    return F.when(enough, STATS[stat](src, own.rowsBetween(-(lag + window - 1), -lag)))


def lagged(source: str, n: int) -> Column:
    """The value n rows ago, across segments."""
    return F.lag(source, n).over(by_time()) if n else F.col(source)


def feature(spec: FeatureSpec) -> Column:
    if spec.stat in ("lag", "identity"):
        return lagged(spec.source, spec.lag).alias(spec.name)
    return rolling(spec.source, spec.stat, spec.window, spec.lag).alias(spec.name)


def default_catalog(with_kernels: bool = False) -> list[FeatureSpec]:
    """13 sources by rolling statistics, 6 by lags, and the calendar: 606 features; and three kernels, which cost far more."""
    out = []
    for s in SOURCES:
        for stat, windows in (("mean", WINDOWS), ("var", WINDOWS[1:]), ("min", WINDOWS), ("max", WINDOWS), ("iqr", WINDOWS[2:]), ("ptp", WINDOWS[1:])):
            out += [FeatureSpec(f"{s}_rolling_{stat}_{w}", s, stat, w) for w in windows]
    out += [FeatureSpec(f"{s}_lag_{n}", s, "lag", 1, n) for s in LAGGED for n in LAGS]
    out += [FeatureSpec(f"{s}_id", s, "identity", 1, 0, False) for s in CALENDAR]
    if with_kernels:  # dfa_alpha is the rescaled-range exponent under a second name, of another column
        made = (("hurst", "log_close", "hurst"), ("sample_entropy", "return", "sample_entropy"), ("dfa_alpha", "return", "hurst"))
        out += [FeatureSpec(f"{name}_{KERNEL_WINDOW}", s, stat, KERNEL_WINDOW) for name, s, stat in made]
    return out


def build(df: DataFrame, specs: Iterable[FeatureSpec]) -> DataFrame:
    """All features; names must differ. A few are window functions, in one projection; MANY or more go through one pass (see `incremental`)."""
    specs = list(specs)
    names = [s.name for s in specs]
    if len(set(names)) < len(names):
        raise ValueError(f"features with one name: {sorted({n for n in names if names.count(n) > 1})}")
    rolled = [s for s in specs if s.stat in incremental.STATS and STATS[s.stat] is BUILT_IN[s.stat]]
    rolled = rolled if len(rolled) >= MANY else []
    out = with_runs(df)
    if rolled:
        out = incremental.rolling_features(out, [(s.name, s.source, s.stat, s.window, s.lag) for s in rolled])
    out = out.select("*", *(feature(s) for s in specs if s.stat not in KERNELS and s not in rolled)).drop("seg_run")
    for s in specs:
        if s.stat in KERNELS:
            out = kernels.bounded_batch(out, s.name, KERNELS[s.stat], s.source, s.window, s.lag)
    return out.select(*df.columns, *names)


def warmup(specs: Iterable[FeatureSpec]) -> int:
    return max((s.update_samples for s in specs), default=0)


def by_importance(specs: Sequence[FeatureSpec], importance: dict[str, float]) -> list[FeatureSpec]:
    """Most important first, unknown ones last in their order."""
    return sorted(specs, key=lambda s: -importance.get(s.name, -math.inf))


def correlations(df: DataFrame, names: Sequence[str], least: int = 8) -> np.ndarray:
    """|correlation| of each pair of columns over the rows that have both; 0 with fewer than `least` of those, or without variance.

    Each task sums up the products of its rows as matrices, the rows of the matrices are summed up side
    by side, and their sums (a few numbers for each pair) come to the driver.
    """
    k = len(names)
    middle = df.agg(*(F.avg(F.when(~F.isnan(n), F.col(n))).alias(str(i)) for i, n in enumerate(names))).first()
    shift = np.array([x or 0.0 for x in middle])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1) - shift
            has = np.isfinite(x)
            x, has = np.where(has, x, 0.0), has.astype(float)
            total += [has.T @ has, x.T @ has, (x * x).T @ has, x.T @ x]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([part] * k, pa.int32()), pa.array([total[:, i].tobytes() for i in range(k)], pa.binary())], ["i", "part", "sums"])

    def add(group: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(b) for b in group.column("sums").to_pylist())
        return pa.table({"i": group.column("i").slice(0, 1), "part": group.column("part").slice(0, 1), "sums": [whole.tobytes()]})

    schema = "i int, part int, sums binary"
    made = df.select(*names).mapInArrow(moments, schema)
    made = made.withColumn("part", (F.col("part") % 64).cast("int")).groupBy("i", "part").applyInArrow(add, schema).groupBy("i").applyInArrow(add, schema)
    n, x, xx, xy = np.array([np.frombuffer(r.sums).reshape(4, k) for r in made.orderBy("i").collect()]).transpose(1, 0, 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        var = (n * xx - x * x) * (n * xx.T - x.T * x.T)
        return np.where((n >= least) & (var > 0), np.abs(n * xy - x * x.T) / np.sqrt(np.where(var > 0, var, 1.0)), 0.0)


def drop_correlated(df: DataFrame, names: Sequence[str], threshold: float = 0.95, least: int = 8) -> list[str]:
    """Greedy: names in order, without those whose |correlation| with a kept one is above the threshold."""
    if not names:
        return []
    value = correlations(df, names, least)
    kept: list[int] = []
    for i in range(len(names)):
        if not kept or not (value[i, kept] > threshold).any():
            kept.append(i)
    return [names[i] for i in kept]


def independent_stream(spark: SparkSession, n: int = 256, seed: int = 0) -> DataFrame:
    """A synthetic stream to find features that are alike by their definition: sources are independent normal numbers, the calendar one turn."""
    turn = 2 * math.pi * F.col("id") / (n - 1)
    columns = [F.randn(seed + k).alias(c) for k, c in enumerate(dict.fromkeys((*SOURCES, *LAGGED, "log_close")))]
    calendar = [(F.sin if c.endswith("sin") else F.cos)(turn).alias(c) for c in CALENDAR]
    rows = spark.range(0, n, 1, 1)
    return rows.select(F.lit("synthetic").alias("instrument"), F.col("id").alias("open_time"), F.lit(0).cast("long").alias("segment_id"), *columns, *calendar)


def without_alike(spark: SparkSession, specs: Sequence[FeatureSpec], threshold: float = 0.95) -> list[FeatureSpec]:
    """Specs in order (by importance, say), without those that follow a kept one on the synthetic stream."""
    kept = set(drop_correlated(build(independent_stream(spark), specs), [s.name for s in specs], threshold))
    return [s for s in specs if s.name in kept]


def undefined_flags(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Each column with 0.0 for null or NaN, and <name>__undef."""
    bad = lambda n: F.col(n).isNull() | F.isnan(n)
    return df.withColumns({f"{n}__undef": bad(n).cast("int") for n in names} | {n: F.when(bad(n), 0.0).otherwise(F.col(n)) for n in names})


def select_features(columns: Sequence[str], catalog: Sequence[FeatureSpec], other: Sequence[str] = ()) -> list[str]:
    """Of a training table's columns those that serving computes too."""
    known = {s.name for s in catalog} - set(other)
    return [c for c in columns if c in known]
