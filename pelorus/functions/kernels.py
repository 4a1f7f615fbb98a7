"""Numeric kernels over trailing windows, sent to Python as Arrow arrays."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelorus.functions.metrics import join_by

Kernel = Callable[[np.ndarray], float]
#: Windows that a kernel takes at a time, and rows of an instrument that one task has.
AT_ONCE = 512
CHUNK = 8192


def by_rows(many: Callable[..., np.ndarray]) -> Kernel:
    """A kernel of one window from one of windows (rows, values); bounded_batch uses the latter."""

    @functools.wraps(many)
    def one(x: np.ndarray, *args, **kwargs) -> float:
        return float(many(np.asarray(x, float)[None, :], *args, **kwargs)[0])

    one.many = many
    return one


def sliding(kernel: Kernel) -> Callable[[Callable], Callable]:
    """Give a kernel its form over all windows of a series (values, window), in which neighbouring windows share work."""

    def mark(slide: Callable[..., np.ndarray]) -> Callable[..., np.ndarray]:
        kernel.slide = slide
        return slide

    return mark


def _scales(n: int) -> np.ndarray:
    return np.unique(np.exp(np.linspace(np.log(8), np.log(n / 2), 6)).astype(int))


def _rescaled(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R/S of the parts along the last axis (0 where there is none), and whether there is one."""
    dev = np.cumsum(parts - parts.mean(axis=-1, keepdims=True), axis=-1)
    r, s = dev.max(axis=-1) - dev.min(axis=-1), parts.std(axis=-1)
    ok = (r > 0) & (s > 0)
    return np.where(ok, r, 0.0) / np.where(ok, s, 1.0), ok


@by_rows
def hurst(x: np.ndarray) -> np.ndarray:
    """Rescaled-range exponent: slope of ln(R/S) on ln(scale) over six log-spaced scales from 8 to n/2; NaN below 32 values."""
    n = x.shape[1]
    if n < 32:
        return np.full(len(x), np.nan)
    found = []
    for m in _scales(n):
        ratio, ok = _rescaled(x[:, : n // m * m].reshape(len(x), -1, m))
        with np.errstate(divide="ignore", invalid="ignore"):
            found.append(np.log(ratio.sum(axis=1) / ok.sum(axis=1)))
    return _slope(np.log(_scales(n)), np.array(found).T)


@sliding(hurst)
def _hurst_slide(x: np.ndarray, window: int) -> np.ndarray:
    """A part's R/S is the same in every window that has it: it is made once for each place, and a window adds up every m-th."""
    count = len(x) - window + 1
    if window < 32:
        return np.full(count, np.nan)
    found = []
    for m in _scales(window):
        parts = np.lib.stride_tricks.sliding_window_view(x, m)
        made = [_rescaled(parts[i : i + 16 * AT_ONCE]) for i in range(0, len(parts), 16 * AT_ONCE)]
        ratio, ok = (np.concatenate(v) for v in zip(*made))
        at = range(0, window // m * m, m)
        with np.errstate(divide="ignore", invalid="ignore"):
            found.append(np.log(np.array([ratio[k : k + count] for k in at]).sum(axis=0) / sum(ok[k : k + count].astype(int) for k in at)))
    return _slope(np.log(_scales(window)), np.array(found).T)


def _slope(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Slope of each row of b on a, of the places where it is finite; NaN with fewer than two."""
    has = np.isfinite(b)
    k = has.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean_a, mean_b = (has * a).sum(axis=1) / k, np.where(has, b, 0.0).sum(axis=1) / k
        da, db = np.where(has, a - mean_a[:, None], 0.0), np.where(has, b - mean_b[:, None], 0.0)
        return np.where(k >= 2, (da * db).sum(axis=1) / (da * da).sum(axis=1), np.nan)


@by_rows
def sample_entropy(x: np.ndarray, m: int = 2, tolerance: float = 0.2) -> np.ndarray:
    """-ln of the share of pairs of m-templates within tolerance * std that stay so with one value more; NaN without pairs."""
    n = x.shape[1]
    r = tolerance * x.std(axis=1)
    if n <= m + 1:
        return np.full(len(x), np.nan)
    a, b = np.zeros(len(x)), np.zeros(len(x))
    for gap in range(1, n - m):  # templates that start `gap` values apart
        near = np.abs(x[:, gap:] - x[:, :-gap]) <= r[:, None]
        same = near[:, : n - gap - m + 1].copy()
        for k in range(1, m):
            same &= near[:, k : n - gap - m + 1 + k]
        longer = same[:, : n - gap - m] & near[:, m : n - gap]
        a += longer.sum(axis=1)
        b += same[:, : n - gap - m].sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((r > 0) & (a > 0) & (b > 0), -np.log(a / b), np.nan)


@sliding(sample_entropy)
def _entropy_slide(x: np.ndarray, window: int, m: int = 2, tolerance: float = 0.2) -> np.ndarray:
    """A pair's distance is the same in every window that has it: it is made once, and a window only counts those within its tolerance.

    Counting goes along the series: the pairs at one place of all windows are consecutive distances.
    """
    count, t = len(x) - window + 1, window - m  # templates of a window
    views = np.lib.stride_tricks.sliding_window_view(x, window)
    if count < AT_ONCE:
        return sample_entropy.many(views, m, tolerance)
    if t <= 1:
        return np.full(count, np.nan)
    r = tolerance * np.concatenate([views[i : i + AT_ONCE].std(axis=1) for i in range(0, count, AT_ONCE)])
    totals = np.zeros((2, count), np.int64)
    few, hit = np.zeros(count, np.uint8), np.empty(count, bool)
    for gap in range(1, t):  # templates that start `gap` values apart
        d = np.abs(x[gap:] - x[:-gap])
        near = d[: len(d) - m].copy()
        for k in range(1, m):
            np.maximum(near, d[k : len(d) - m + k], out=near)
        for total, far in zip(totals, (near, np.maximum(near, d[m:]))):
            for at in range(t - gap):
                np.less_equal(far[at : at + count], r, out=hit)
                few += hit.view(np.uint8)
                if at % 255 == 254:  # before the small counters overflow
                    total += few
                    few[:] = 0
            total += few
            few[:] = 0
    b, a = totals
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((r > 0) & (a > 0) & (b > 0), -np.log(a / b), np.nan)


def kernel_udf(kernel: Kernel) -> Callable[[Column], Column]:
    """array<double> -> double; an error, NaN or infinity in the kernel is null."""

    @F.pandas_udf("double")
    def run(windows: pd.Series) -> pd.Series:
        out = []
        for w in windows:
            try:
                v = kernel(np.asarray(w, float)) if w is not None else np.nan
            except Exception:  # a kernel may not like a window; the row then has no value
                v = np.nan
            out.append(v if v is not None and np.isfinite(v) else None)
        return pd.Series(out, dtype="float64")

    return run


def bounded_batch(df: DataFrame, name: str, kernel: Kernel, source: str, window: int, lag: int = 1) -> DataFrame:
    """Kernel over the `window` most recent non-null values that end `lag` values ago, across segments; null before there are enough.

    An instrument's values are numbered, cut into chunks, and each chunk gets the values before it that
    its windows need; windows are views of a chunk's array. So nothing grows with the window, and the
    chunks of one instrument run in many tasks. An error, NaN or infinity in the kernel is null.
    """
    src = F.col(source)
    own = Window.partitionBy("instrument", src.isNotNull()).orderBy("open_time", F.xxhash64(*df.columns))  # rows of one time are numbered alike each time
    reach = lag + window - 1
    length = max(CHUNK, 4 * reach)
    at = df.withColumn("__nth", F.row_number().over(own) - 1).withColumn("__chunk", F.when(src.isNotNull(), F.floor(F.col("__nth") / length)))
    values = at.where(src.isNotNull()).select("instrument", "__chunk", "__nth", src.cast("double").alias("__x"))
    late = values.where(F.col("__nth") % length >= length - reach).withColumn("__chunk", F.col("__chunk") + 1)
    many, slide = getattr(kernel, "many", None), getattr(kernel, "slide", None)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__nth")
        x, nth = part["__x"].to_numpy(float), part["__nth"].to_numpy()
        first = int(key[1]) * length
        rows = np.flatnonzero((nth >= first) & (np.arange(len(nth)) >= reach))
        out = np.full(len(nth), np.nan)
        if len(rows) and slide is not None:  # a chunk's rows are consecutive
            out[rows] = slide(x[rows[0] - reach : rows[-1] - reach + window], window)
        elif len(rows):
            views = np.lib.stride_tricks.sliding_window_view(x, window)
            for i in range(0, len(rows), AT_ONCE):
                some = rows[i : i + AT_ONCE]
                out[some] = _applied(kernel, many, views[some - reach])
        mine = nth >= first
        return pd.DataFrame({"instrument": [key[0]] * int(mine.sum()), "__nth": nth[mine], name: [v if np.isfinite(v) else None for v in out[mine]]})

    kind = dict(df.dtypes)["instrument"]
    made = values.union(late).groupBy("instrument", "__chunk").applyInPandas(run, f"instrument {kind}, __nth int, `{name}` double")
    missing = at.where(src.isNull()).withColumn(name, F.lit(None).cast("double")).drop("__nth", "__chunk")
    known = join_by(at.where(src.isNotNull()), made, ["instrument", "__nth"]).drop("__nth", "__chunk")
    return known.select(*df.columns, name).union(missing.select(*df.columns, name))


def _applied(kernel: Kernel, many: Callable | None, windows: np.ndarray) -> np.ndarray:
    if many is not None:
        try:
            return np.asarray(many(windows), float)
        except Exception:  # a kernel may not like one of the windows: then each for itself
            pass
    out = np.full(len(windows), np.nan)
    for i, w in enumerate(windows):
        try:
            out[i] = kernel(w)
        except Exception:  # the row then has no value
            pass
    return out
