"""Bootstrap, autocovariance, concurrency and overfitting statistics."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelorus.functions import resampling
from pelorus.functions.metrics import running


def autocovariance(x: np.ndarray, max_lag: int) -> np.ndarray:
    """Lag 0 is the population variance, lag k the mean of the n - k products around the mean of all."""
    d = np.asarray(x, float) - np.mean(x)
    return np.array([np.mean(d[k:] * d[: len(d) - k]) if len(d) > k else 0.0 for k in range(max_lag + 1)])


def autocovariances(df: DataFrame, value: str, lags: list[int], by: str = "instrument", order: str = "idx") -> DataFrame:
    """The same for each group, one row for each lag."""
    w, whole = Window.partitionBy(by).orderBy(order), Window.partitionBy(by)
    d = df.withColumn("__d", F.col(value) - F.avg(value).over(whole))
    d = d.select(by, *((F.col("__d") * F.lag("__d", k).over(w)).alias(f"k{k}") for k in lags))
    stack = ", ".join(f"{k}, k{k}" for k in lags)
    return d.groupBy(by).agg(*(F.avg(f"k{k}").alias(f"k{k}") for k in lags)).select(by, F.expr(f"stack({len(lags)}, {stack}) AS (lag, autocovariance)"))


def block_length(x: np.ndarray, max_lag: int | None = None) -> int:
    """Politis and White's length (2004, corrected 2009) for the stationary bootstrap, between 1 and a quarter of the values.

    The bandwidth is the first lag that is small and has only small autocorrelations in the lags behind
    it; the flat-top window goes up to it. Series without variance, or without a positive spectrum at
    zero, have the cube root of their length. Fewer than 8 values are an error.
    """
    x = np.asarray(x, float)
    n = len(x)
    if n < 8:
        raise ValueError(f"a block length needs 8 values or more, not {n}")
    return block_of_covariance(autocovariance(x, max_lag or most_lags(n)), n)


def most_lags(n: int) -> int:
    return max(1, min(n // 4, max(8, math.ceil(8 * math.log10(n)))))


def block_of_covariance(cov: np.ndarray, n: int) -> int:
    """The length from autocovariances of lags 0, 1, ... (those beyond most_lags(n) don't count) and the number of values."""
    cov = cov[: most_lags(n) + 1]
    most = len(cov) - 1
    plain = max(1, math.ceil(n ** (1 / 3)))
    if cov[0] <= 0:
        return plain
    small = np.abs(cov / cov[0]) < 2 * math.sqrt(math.log10(n) / n)
    run = max(5, math.ceil(math.sqrt(math.log10(n))))
    width = next((k for k in range(1, most - run + 1) if small[k : k + run + 1].all()), most)
    lag = np.arange(1, width + 1)
    taper = np.clip(2 * (1 - lag / width), 0, 1) * cov[1 : width + 1]
    spectrum, slope = float(cov[0] + 2 * taper.sum()), float(2 * (lag * taper).sum())
    if not (math.isfinite(spectrum) and math.isfinite(slope)) or spectrum <= 0:
        return plain
    length = (2 * slope**2 / spectrum**2 * n) ** (1 / 3)
    return max(1, min(round(length), n // 4)) if length >= 1 else 1


def stationary_indices(n: int, block: int, rng: np.random.Generator) -> np.ndarray:
    """Circular blocks of geometric length from uniform starts."""
    new = rng.random(n) < 1 / block
    new[0] = True
    heads = np.flatnonzero(new)
    start = rng.integers(0, n, len(heads))
    size = np.diff(np.append(heads, n))
    return (np.repeat(start, size) + np.arange(n) - np.repeat(heads, size)) % n


def sharpe(x: np.ndarray) -> float:
    sd = np.std(x, ddof=1) if len(x) > 1 else 0.0
    return float(np.mean(x) / sd) if sd > 1e-10 else 0.0


def sortino(x: np.ndarray) -> float:
    down = x[x < 0]
    sd = np.std(down, ddof=1) if len(down) > 1 else 0.0
    return float(np.mean(x) / sd) if sd > 1e-10 else float("nan")


def max_drawdown(x: np.ndarray) -> float:
    eq = np.cumsum(x)
    return float(-(np.maximum.accumulate(eq) - eq).max()) if len(eq) else 0.0


def bootstrap(spark: SparkSession, x: np.ndarray, metric: Callable[[np.ndarray], float], n: int = 5000, block: int | None = None, confidence: float = 0.95, seed: int = 42, scheme: str = "stationary_block") -> DataFrame:
    """point, lo, hi, se and n_finite of a metric over resamples of one series.

    The series (one number for each trade or bar of a run) is sent to the tasks; each resample has a
    seed of its own, so the result doesn't depend on how they are dealt out. Schemes: stationary_block, iid.
    """
    x = np.asarray(x, float)
    length = 1 if scheme == "iid" or not len(x) else block or block_length(x)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for b in part["id"]:
                rng = np.random.default_rng([seed, int(b)])
                at = rng.integers(0, len(x), len(x)) if scheme == "iid" else stationary_indices(len(x), length, rng)
                out.append(metric(x[at]))
            yield pd.DataFrame({"value": out})

    samples = spark.range(n if len(x) else 0).mapInPandas(run, "value double").where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('Infinity')")
    tail = (1 - confidence) / 2
    return samples.agg(
        F.lit(float(metric(x)) if len(x) else None).cast("double").alias("point"),
        F.percentile("value", tail).alias("lo"), F.percentile("value", 1 - tail).alias("hi"), F.stddev_samp("value").alias("se"), F.count("*").alias("n_finite"),
    )


def sharpe_interval(df: DataFrame, by: str, order: list[str], value: str, block: int = 20, groups: int = 1000, n: int = 2000, confidence: float = 0.95, seed: int = 42) -> tuple[float, float]:
    """Bootstrap interval of the Sharpe ratio of any number of rows, from at most `groups` rows of sums.

    Blocks of `block` consecutive rows of a series are dealt to groups by hash; groups are resampled. So
    serial dependence within blocks is kept and what reaches the driver doesn't grow with the data.
    """
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    dealt = df.withColumn("__block", F.floor(nth / block)).withColumn("__group", F.pmod(F.xxhash64(by, "__block"), F.lit(groups)))
    x = F.col(value)
    sums = np.array([tuple(r) for r in dealt.groupBy("__group").agg(F.count(x), F.sum(x), F.sum(x * x)).orderBy("__group").drop("__group").collect()], float).reshape(-1, 3)
    if len(sums) < 2:
        return float("nan"), float("nan")
    rng = np.random.default_rng(seed)
    c, s, q = sums[rng.integers(0, len(sums), (n, len(sums)))].sum(axis=1).T
    var = np.maximum(0, (q - s * s / c) / np.maximum(1, c - 1))
    ratio = np.where(var > 1e-20, s / c / np.sqrt(np.maximum(var, 1e-20)), 0.0)
    lo, hi = np.quantile(ratio, [(1 - confidence) / 2, (1 + confidence) / 2])
    return float(lo), float(hi)


def calibration_intervals(trace: DataFrame, by: str, order: str, block: int = 20, groups: int = 200, bins: int = 200, n_ece: int = 10, n: int = 500, confidence: float = 0.95, seed: int = 42) -> dict[str, list[float]]:
    """Bootstrap intervals of Brier score, ECE and PR-AUC of any number of predictions (y, p), from groups * bins rows of sums.

    As sharpe_interval: blocks of consecutive rows are dealt to groups, and groups are resampled. p goes by
    `bins` cells of equal width, in which the order counts as random for PR-AUC; ECE's bins are made of such cells.
    """
    nth = F.row_number().over(Window.partitionBy(by).orderBy(order))
    dealt = trace.withColumn("__block", F.floor(nth / block)).withColumn("__group", F.pmod(F.xxhash64(by, "__block"), F.lit(groups)))
    cell = F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)).cast("int")
    se = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    rows = dealt.groupBy("__group", cell.alias("__cell")).agg(F.count("*"), F.sum("p"), F.sum("y"), F.sum(se)).collect()
    if not rows:
        return {}
    sums = np.zeros((groups, bins, 4))
    for r in rows:
        sums[r[0], r[1]] = r[2:]
    sums = sums[sums[:, :, 0].sum(axis=1) > 0]
    rng = np.random.default_rng(seed)
    edges = np.searchsorted(np.cumsum(sums.sum(axis=0)[:, 0]) / sums[:, :, 0].sum(), np.arange(1, n_ece) / n_ece)
    of_bin = np.searchsorted(edges, np.arange(bins), side="left")
    found: dict[str, list[float]] = {"brier": [], "ece": [], "pr_auc": []}
    for _ in range(n):
        s = sums[rng.integers(0, len(sums), len(sums))].sum(axis=0)
        total, hits = s[:, 0].sum(), s[:, 2].sum()
        found["brier"].append(s[:, 3].sum() / total)
        k, p, y = (np.bincount(of_bin, s[:, i], n_ece) for i in range(3))
        found["ece"].append(np.abs(p - y).sum() / total)
        if hits:
            y, k = s[::-1, 2], s[::-1, 0]
            precision = (np.cumsum(y) - y / 2) / np.maximum(np.cumsum(k) - k / 2, 1e-12)
            found["pr_auc"].append(float((y * np.minimum(precision, 1.0)).sum() / hits))
    tail = (1 - confidence) / 2
    return {name: [float(q) for q in np.quantile(v, [tail, 1 - tail])] for name, v in found.items() if v}


def grouped_bootstrap(df: DataFrame, by: str, value: str, order: str, metric: str, n: int = 1000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """point, lo, hi of a metric (mean, sharpe, sortino, max_drawdown) of each group by n stationary resamples, over many tasks (see `resampling`).

    Groups of fewer than 8 rows have no interval; a null group is one like others.
    """
    made = resampling.samples(df, by, value, order, metric, n, seed)
    return resampling.named(resampling.intervals(made, confidence), by, "point", "lo", "hi")


def stratified_pr_auc(y: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> float:
    """Average precision (ties together) of one resample that keeps the classes' sizes."""
    pos, neg = p[y == 1], p[y == 0]
    pos, neg = rng.choice(pos, len(pos)), rng.choice(neg, len(neg))
    values = np.concatenate([pos, neg])
    truth = np.concatenate([np.ones(len(pos)), np.zeros(len(neg))])
    order = np.argsort(-values, kind="stable")
    values, hits = values[order], np.cumsum(truth[order])
    last = np.append(np.flatnonzero(np.diff(values)), len(values) - 1)
    recall = hits[last] / len(pos)
    return float((np.diff(recall, prepend=0) * hits[last] / (last + 1)).sum())


def concurrency(trades: DataFrame, width: int = 4096) -> DataFrame:
    """Open trades at each time that some trade opens or closes: t, delta, open (over [t, next t)).

    Trades have n_open and n_close (integers). Only the event times are rows; running sums go by
    blocks of `width` times, so no task sees all.
    """
    end = F.greatest(F.col("n_close"), F.col("n_open"))
    events = trades.select(F.col("n_open").alias("t"), F.lit(1).alias("d")).union(trades.select(end.alias("t"), F.lit(-1).alias("d")))
    each = events.groupBy("t").agg(F.sum("d").alias("delta")).withColumn("g", F.lit(0))
    out = running(each, ["g"], "t", {"before": "delta"}, F.floor(F.col("t") / width))
    return out.select("t", "delta", (F.col("before") + F.col("delta")).alias("open"))


def with_following(df: DataFrame, t: str, width: int) -> DataFrame:
    """next: the next greater value of t (distinct integers), null after the last; by blocks of t and blocks of those."""
    block, above = F.floor(F.col(t) / width), F.floor(F.col("__k") / 4096)
    blocks = df.groupBy(block.alias("__k")).agg(F.min(t).alias("__head")).withColumn("__above", above)
    tops = blocks.groupBy("__above").agg(F.min("__head").alias("__top"))
    tops = tops.select("__above", F.lead("__top").over(Window.orderBy("__above")).alias("__after"))  # a row for each 4096 * width
    inner = Window.partitionBy("__above").orderBy("__k")
    blocks = blocks.join(tops, "__above").select("__k", F.coalesce(F.lead("__head").over(inner), F.col("__after")).alias("__after"))
    own = Window.partitionBy("__k").orderBy(t)
    out = df.withColumn("__k", block).join(blocks, "__k").withColumn("next", F.coalesce(F.lead(t).over(own), F.col("__after")))
    return out.drop("__k", "__after")


def uniqueness(trades: DataFrame, width: int = 64) -> DataFrame:
    """Mean of 1 / open trades over each trade's times [n_open, max(n_close, n_open + 1)): trade_id, uniqueness.

    A trade's mean is the difference of two prefix sums, those at its ends, found by equality joins;
    the work grows with the trades, not with their length.
    """
    spans = trades.select("trade_id", F.col("n_open").alias("a"), F.greatest(F.col("n_close"), F.col("n_open") + 1).alias("b"))
    counts = concurrency(spans.select(F.col("a").alias("n_open"), F.col("b").alias("n_close")))
    steps = with_following(counts, "t", width).where("open > 0").select("t", "next", (1.0 / F.col("open")).alias("w"))
    # area before each step's start: prefix sums of (length of the step) * w
    steps = steps.withColumn("area", (F.col("next") - F.col("t")) * F.col("w")).withColumn("g", F.lit(0))
    sums = running(steps, ["g"], "t", {"before": "area"}, F.floor(F.col("t") / width))
    at_open = sums.select(F.col("t").alias("a"), F.col("before").alias("s_a"))
    at_close = sums.select(F.col("next").alias("b"), (F.col("before") + F.col("area")).alias("s_b"))
    out = spans.join(at_open, "a").join(at_close, "b")
    return out.select("trade_id", ((F.col("s_b") - F.col("s_a")) / (F.col("b") - F.col("a"))).alias("uniqueness"))


def sequential_bootstrap(trades: DataFrame, by: str, value: str, metric: str, n: int = 1000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """point, lo, hi of a metric of each group's trades (trade_id, n_open, n_close), drawn in proportion to their average uniqueness."""
    weighed = trades.join(uniqueness(trades), "trade_id", "left")
    made = resampling.weighted_samples(weighed, by, value, "uniqueness", "trade_id", metric, n, seed)
    return resampling.named(resampling.intervals(made, confidence), by, "point", "lo", "hi")


def cscv_pbo(returns: DataFrame, n_chunks: int = 16, eps: float = 1e-12, periods: int | None = None) -> DataFrame:
    """Probability of backtest overfitting from returns (strategy, period from 0, r): a row for each split of the chunks.

    Per strategy and chunk only n, sum and sum of squares are kept; a task takes its strategies' products with the
    matrix of all C(S, S/2) in-sample sets, and hands on a row for each set: first the best, then how many are below it. With `periods` given, a period without a row counts as a return of 0. Columns: combo, best (first strategy with the best in-sample Sharpe), rank (of it out of sample), logit.
    """
    spark = returns.sparkSession
    n = periods or returns.agg(F.max("period") + 1).first()[0] or 0
    size = n // n_chunks
    if not size:
        raise ValueError("fewer periods than chunks")
    chunked = returns.where(F.col("period") < size * n_chunks).withColumn("chunk", F.floor(F.col("period") / size).cast("int"))
    stats = chunked.groupBy("strategy", "chunk").agg(F.count("*").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    if periods is not None:  # sums of the periods that have rows, over all periods of each chunk
        grid = returns.select("strategy").distinct().withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
        stats = grid.join(stats, ["strategy", "chunk"], "left").select("strategy", "chunk", F.lit(size).alias("n"), F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("q", F.lit(0.0)).alias("q"))
    chosen = np.array([np.isin(np.arange(n_chunks), c) for c in itertools.combinations(range(n_chunks), n_chunks // 2)])
    at = lambda c: F.array(*(F.coalesce(F.sum(F.when(F.col("chunk") == k, F.col(c).cast("double"))), F.lit(0.0)) for k in range(n_chunks))).alias(c)
    kind = dict(returns.dtypes)["strategy"]
    each = stats.groupBy(F.col("strategy").cast("long").alias("strategy")).agg(at("n"), at("s"), at("q")).persist()

    def first_of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best in-sample strategy of each set among a task's strategies."""
        top = None
        for strategy, inside, outside in _sharpes(parts, chosen, eps):
            if top is None:
                top = [inside, np.full(len(chosen), strategy), outside]
            better = (inside > top[0]) | (inside == top[0]) & (strategy < top[1])
            top = [np.where(better, new, old) for new, old in zip((inside, strategy, outside), top)]
        if top is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(chosen), dtype=np.int32)), *map(pa.array, top)], ["combo", "inside", "strategy", "outside"])

    tops = each.mapInArrow(first_of, "combo int, inside double, strategy long, outside double")
    tops = tops.groupBy("combo").agg(F.max(F.struct("inside", (-F.col("strategy")).alias("first"), "outside")).alias("b"))
    found = tops.select("combo", (-F.col("b.first")).alias("best"), F.col("b.outside").alias("outside")).orderBy("combo").collect()  # a row for each set of chunks
    best, limit = np.array([r.best for r in found], np.int64), np.array([r.outside for r in found])

    def below(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many of a task's strategies are worse out of sample than the best in-sample one of each set."""
        total, n = np.zeros(len(chosen), np.int64), 0
        for strategy, _, outside in _sharpes(parts, chosen, eps):
            total += (outside < limit) & (strategy != best)
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(chosen), dtype=np.int32)), pa.array(best), pa.array(total), pa.array(np.full(len(chosen), n))], ["combo", "best", "below", "n"])

    if not len(found):
        return spark.createDataFrame([], f"combo int, best {kind}, rank long, logit double")
    counted = each.mapInArrow(below, "combo int, best long, below long, n long").groupBy("combo", "best").agg((F.sum("below") + 1).alias("rank"), F.sum("n").alias("n"))
    omega = (F.col("rank") - 0.5) / F.col("n")
    return counted.select("combo", F.col("best").cast(kind).alias("best"), "rank", F.log(omega / (1 - omega)).alias("logit"))


def _sharpes(parts: Iterator[pa.RecordBatch], chosen: np.ndarray, eps: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each strategy (n, s, q of its chunks) the Sharpe ratios within and outside of each set of chunks; -inf without rows."""
    sides = chosen.astype(float), (~chosen).astype(float)
    for part in parts:
        for r in range(part.num_rows):
            sums = [part.column(c)[r].values.to_numpy() for c in ("n", "s", "q")]
            out = []
            for side in sides:
                n, s, q = (side @ x for x in sums)
                mean = s / np.maximum(n, 1)
                sd = np.sqrt(np.maximum(0, (q - n * mean * mean) / np.maximum(n - 1, 1)))
                out.append(np.where(n > 0, mean / np.maximum(sd, eps), -np.inf))
            yield part.column("strategy")[r].as_py(), *out


def pbo(splits: DataFrame) -> DataFrame:
    return splits.agg(F.avg((F.col("logit") < 0).cast("double")).alias("pbo"), F.percentile("logit", 0.5).alias("median_logit"), F.count("*").alias("n_combos"))
