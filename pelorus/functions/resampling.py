"""Block bootstrap of series of any length over many tasks, with the result of the in-memory one for the same seed.

A resample's blocks follow from the seed, the resample's number and the number of a chunk of its positions, so any
task can draw any part of it. A task has a range of resamples of one series, whose buckets of positions it gets one after
another. It keeps up to WHOLE values as an array, of a longer series in a file of its own, which it maps; and it makes a resample
chunk by chunk, adding up moments and the summaries (sum, highest, lowest, fall) of a path. So neither memory nor a row
grows with the series, and what is shuffled is the series once for each range, not the blocks.
"""

from __future__ import annotations

import contextlib
import math
import mmap
import os
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelorus.functions import metrics

#: Positions of a resample that have a generator of their own.
CHUNK = 1 << 16
#: Values of a series that a task keeps in memory, positions of a bucket, least resamples that go together, and most ranges of resamples of a series.
WHOLE = 1 << 21
BUCKET = 1 << 14
TOGETHER = 64
RANGES = 24
#: Distinct probabilities of a bucket of the PR curve.
LEVELS = 1 << 16
#: The number that stands for the series as it is.
ORIGINAL = -1
MOST_LAGS = 256


# Drawing


def heads(n: int, block: int, seed: int, resample: int, chunk: int, width: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a chunk at which blocks begin, each with probability 1 / block (the resample's first always), and the places they read from."""
    rng = np.random.default_rng([seed, resample, chunk])
    size = min(width, n - chunk * width)
    if block == 1:
        at = np.arange(size)
    else:
        many = int(size / block + 8 * math.sqrt(size / block)) + 16
        at = np.cumsum(rng.geometric(1 / block, many)) - 1
        while at[-1] < size:
            at = np.concatenate([at, at[-1] + np.cumsum(rng.geometric(1 / block, many))])
        at = at[at < size]
        if chunk == 0 and (not len(at) or at[0]):
            at = np.concatenate([[0], at])
    return chunk * width + at, rng.integers(0, n, len(at))


def chunk_blocks(n: int, block: int, seed: int, resample: int, chunk: int, width: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """start and size of the blocks that fill a chunk of a resample's positions; the first may continue one from before. None of them wraps."""
    low, high = chunk * width, min(n, (chunk + 1) * width)
    if resample == ORIGINAL:
        return np.array([low]), np.array([high - low])
    at, start = heads(n, block, seed, resample, chunk, width)
    if not len(at) or at[0] > low:
        before = chunk - 1
        while not len((past := heads(n, block, seed, resample, before, width))[0]):
            before -= 1
        at, start = np.concatenate([[low], at]), np.concatenate([[past[1][-1] + low - past[0][-1]], start])
    size = np.diff(np.append(at, high))
    start %= n
    while (over := start + size > n).any():
        first = n - start[over]
        spot = np.flatnonzero(over) + 1
        rest = size[over] - first
        size[over] = first
        start, size = np.insert(start, spot, 0), np.insert(size, spot, rest)
    return start, size


def blocks(n: int, block: int, seed: int, resample: int, width: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """start and size of all blocks of a resample, in order."""
    parts = [chunk_blocks(n, block, seed, resample, c, width) for c in range(-(-n // width))]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def places(n: int, block: int, seed: int, resample: int, chunk: int, width: int = CHUNK) -> np.ndarray:
    """The places that a chunk of a resample's positions reads, in order."""
    if block == 1 and resample != ORIGINAL:
        return heads(n, block, seed, resample, chunk, width)[1]
    start, size = chunk_blocks(n, block, seed, resample, chunk, width)
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def indices(n: int, block: int, seed: int, resample: int, width: int = CHUNK) -> np.ndarray:
    """The places that a resample reads, in order: circular blocks of geometric length from uniform starts."""
    start, size = blocks(n, block, seed, resample, width)
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(n)


# Statistics


def features(d: np.ndarray, mean: float) -> np.ndarray:
    """Rows that sum up to the moments of all values, and of those below zero: values are given less the mean."""
    down = d + mean < 0
    return np.stack([d, d * d, down, down * d, down * d * d])


def _deviation(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, q - s * s / np.maximum(n, 1)) / np.maximum(n - 1, 1))


def finished(metric: str, n: np.ndarray, mean: np.ndarray, sums: np.ndarray, fall: np.ndarray) -> np.ndarray:
    """A metric of resamples from their sums (rows of `features`): mean, sharpe, sortino, max_drawdown (not above zero).

    A Sharpe ratio without deviation is 0; a Sortino ratio with fewer than two losses, or without deviation, is none (NaN).
    """
    s, q, k, ds, dq = sums
    average = mean + s / n
    if metric == "mean":
        return average
    if metric == "max_drawdown":
        return -fall
    if metric == "sharpe":
        sd = np.where(n > 1, _deviation(n, s, q), 0.0)
        return np.where(sd > 1e-10, average / np.maximum(sd, 1e-300), 0.0)
    if metric == "sortino":
        sd = np.where(k > 1, _deviation(k, ds, dq), 0.0)
        return np.where(sd > 1e-10, average / np.maximum(sd, 1e-300), np.nan)
    raise ValueError(f"unknown metric {metric!r}")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The summary of a path followed by another: (sum, highest and lowest partial sum, greatest fall), column by column."""
    (s, high, low, fall), (t, h, w, f) = a, b
    return np.stack([s + t, np.maximum(high, s + h), np.minimum(low, s + w), np.maximum(np.maximum(fall, f), high - (s + w))])


def folded(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summaries (4, m) of neighbours of one group merged in order, by halves; and the groups."""
    while len(groups) and (groups[1:] == groups[:-1]).any():
        head = np.concatenate([[True], groups[1:] != groups[:-1]])
        nth = np.arange(len(groups)) - np.maximum.accumulate(np.where(head, np.arange(len(groups)), 0))
        left = np.flatnonzero(nth % 2 == 0)
        has = (left + 1 < len(groups)) & (nth[np.minimum(left + 1, len(groups) - 1)] % 2 == 1)
        out = values[:, left]
        out[:, has] = merged(values[:, left[has]], values[:, left[has] + 1])
        values, groups = out, groups[left]
    return values, groups


class Falls:
    """Summaries of stretches of a path, from those of all stretches of 1, 2, 4, ... values."""

    def __init__(self, x: np.ndarray):
        self.tables = [np.stack([x, x, x, np.zeros(len(x))])]
        while 2 << len(self.tables) - 1 <= len(x):
            last, step = self.tables[-1], 1 << len(self.tables) - 1
            self.tables.append(merged(last[:, :-step], last[:, step:]))

    def of(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        out, at, begun = np.zeros((4, len(at))), at.copy(), np.zeros(len(at), bool)
        for k, table in enumerate(self.tables):
            for own, known in ((begun & (size >> k & 1 == 1), True), (~begun & (size >> k & 1 == 1), False)):
                got = table[:, at[own]]
                out[:, own] = merged(out[:, own], got) if known else got
                at[own] += 1 << k
                begun |= own
        return out


def resampled(x: np.ndarray, mean: float, block: int, seed: int, resamples: list[int], metric: str, width: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """The sums of `features` of each resample that the metric needs, and the greatest falls of its path: chunk by chunk."""
    n = len(x)
    sums, fall = np.zeros((5, len(resamples))), np.zeros(len(resamples))
    for k, b in enumerate(resamples):
        path = np.array([0.0, -np.inf, np.inf, 0.0])[:, None]
        for chunk in range(-(-n // width)):
            own = np.take(x, places(n, block, seed, b, chunk, width))
            if metric == "max_drawdown":
                level = np.cumsum(own)
                high = np.maximum.accumulate(level)
                path = merged(path, np.array([level[-1], high[-1], level.min(), (high - level).max()])[:, None])
            elif metric == "sortino":
                sums[:, k] += features(own - mean, mean).sum(axis=1)
            else:
                own -= mean
                sums[:2, k] += own.sum(), own @ own
        fall[k] = path[3, 0]
    return sums, fall


@contextlib.contextmanager
def room(n: int, whole: int) -> Iterator[np.ndarray]:
    """An array for n values: beyond `whole` of them a mapped file in a local directory of Spark's, which has no name and goes with it."""
    if n <= whole:
        yield np.empty(n)
        return
    local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    with tempfile.TemporaryFile(dir=local if os.path.isdir(local) else None) as file:
        file.truncate(8 * n)
        yield np.frombuffer(mmap.mmap(file.fileno(), 8 * n), float)


# Series as tables


def keyed(df: DataFrame, by: str) -> Column:
    """The key as a struct, in which null is a key like others."""
    return F.struct(F.col(by).alias("k")).alias("key")


def positions(df: DataFrame, by: str, value: str, order: str | Sequence[str], *more: str) -> DataFrame:
    """key, at (from 0, by order and then value), x and other columns; rows without a value are left out. The first column of order is a number."""
    order = [order] if isinstance(order, str) else list(order)
    rows = df.where(F.col(value).isNotNull()).select(keyed(df, by), *(F.col(c).alias(f"__o{i}" if i else "__o") for i, c in enumerate(order)), F.col(value).cast("double").alias("x"), *more)
    rows = rows.withColumn("__one", F.lit(1)).withColumn("__order", F.struct("__o", *(f"__o{i}" for i in range(1, len(order))), "x"))
    bounds = metrics.cuts(rows, ["__o"])[0]
    return metrics.running(rows, ["key"], "__order", {"at": "__one"}, metrics.place(F.col("__o"), bounds)).select("key", F.col("at").cast("long").alias("at"), "x", *more)


def in_buckets(rows: DataFrame) -> DataFrame:
    """key, bucket, values: the values of BUCKET positions as an array."""
    cells = rows.groupBy("key", F.floor(F.col("at") / BUCKET).cast("int").alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v"))
    return cells.select("key", "bucket", F.col("v.x").alias("values"))


def covariances(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """key, lag, s: the sums of products of values less the mean, at lags up to MOST_LAGS: each bucket with the first values of the next."""
    nexts = cells.select("key", (F.col("bucket") - 1).alias("bucket"), F.slice("values", 1, MOST_LAGS).alias("following"))
    both = cells.join(nexts, ["key", "bucket"], "left").join(sizes.select("key", "n", "mean"), "key")
    kind = both.schema["key"].dataType

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in range(part.num_rows):
                own, more, n, mean = (part.column(c)[r].as_py() for c in ("values", "following", "n", "mean"))
                x = np.array(own + (more or [])) - mean
                m = len(own)
                lags = range(min(MOST_LAGS, n - 1) + 1)
                s = [float(x[:m][: max(0, len(x) - k)] @ x[k : k + m]) for k in lags]
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array([r] * len(s))), pa.array(lags, pa.int32()), pa.array(s, pa.float64())], ["key", "lag", "s"])

    return both.select("key", "values", "following", "n", "mean").mapInArrow(run, f"key {kind.simpleString()}, lag int, s double").groupBy("key", "lag").agg(F.sum("s").alias("s"))


def with_block_length(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """sizes (key, n, mean) with block: Politis and White's length of each series of 8 values or more."""
    from pelorus.functions import stats

    rows = covariances(cells, sizes).join(sizes.where("n >= 8"), "key")
    chosen = F.pandas_udf(lambda s, n: pd.Series([stats.block_of_covariance(np.array(v) / (m - np.arange(len(v))), int(m)) for v, m in zip(s, n)]), "int")
    each = rows.groupBy("key", "n", "mean").agg(F.transform(F.sort_array(F.collect_list(F.struct("lag", "s"))), lambda v: v["s"]).alias("s"))
    return each.select("key", "n", "mean", chosen("s", "n").alias("block"))


# Resamples over tasks


def samples(df: DataFrame, by: str, value: str, order: str | Sequence[str], metric: str, n: int = 1000, seed: int = 42, block: int | None = None, whole: int | None = None) -> DataFrame:
    """key, resample, value: a metric of the original (resample -1) and of n stationary resamples of each series.

    Series of fewer than 8 values have the original alone. See `finished` for metrics.
    """
    cells = in_buckets(positions(df, by, value, order)).persist()  # read several times; a lost part is made again
    n_of, sum_of = F.sum(F.size("values")), F.sum(F.aggregate("values", F.lit(0.0), lambda a, x: a + x))
    sizes = cells.groupBy("key").agg(n_of.cast("long").alias("n"), (sum_of / n_of).alias("mean"))
    if block is None:
        known = with_block_length(cells, sizes)
        sizes = sizes.join(known.select("key", "block"), "key", "left")
    else:
        sizes = sizes.withColumn("block", F.when(F.col("n") >= 8, F.lit(block)))
    sizes = sizes.withColumn("resamples", F.when(F.col("block").isNull(), 0).otherwise(n))
    many = F.greatest(F.lit(TOGETHER), F.ceil(F.col("resamples") / RANGES).cast("int"))
    asked = sizes.withColumn("many", many).withColumn("range", F.explode(F.sequence(F.lit(0), F.floor(F.col("resamples") / F.col("many")).cast("int"))))
    made = _read(cells, asked, seed, metric, WHOLE if whole is None else whole)
    done = F.pandas_udf(lambda m, mean, sums, fall: pd.Series(finished(metric, m.to_numpy(float), mean.to_numpy(), np.array(sums.tolist(), float).reshape(-1, 5).T, fall.to_numpy())), "double")
    return made.select("key", "resample", done("n", "mean", "sums", "fall").alias("value"))


def _numbers(range_: int, resamples: int, many: int = 0) -> list[int]:
    """The resamples of a range; the original goes with the first."""
    many = many or TOGETHER
    return [*([ORIGINAL] if range_ == 0 else []), *range(range_ * many, min(resamples, (range_ + 1) * many))]


def _read(cells: DataFrame, asked: DataFrame, seed: int, metric: str, whole: int) -> DataFrame:
    """Sums and falls of ranges of resamples: each range's task gets the buckets of its series in order."""
    spark, width, cell = cells.sparkSession, CHUNK, BUCKET
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    about = ["n", "mean", "block", "resamples", "many"]
    met = cells.join(asked, "key").repartition(tasks, "key", "range").sortWithinPartitions("key", "range", "bucket")
    kind = cells.schema["key"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with contextlib.ExitStack() as stack:
            for part in parts:
                for r in range(part.num_rows):
                    bucket, n, mean, block, resamples, many = (part.column(c)[r].as_py() for c in ("bucket", *about))
                    if bucket == 0:
                        stack.close()
                        x = stack.enter_context(room(n, whole))
                    values = part.column("values")[r].values.to_numpy()
                    x[bucket * cell : bucket * cell + len(values)] = values
                    if bucket * cell + len(values) == n and (own := _numbers(part.column("range")[r].as_py(), resamples, many)):
                        sums, fall = resampled(x, mean, block or 1, seed, own, metric, width)
                        m = len(own)
                        yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array([r] * m)), pa.array(own, pa.int32()), pa.array([n] * m, pa.int64()), pa.array([mean] * m), pa.array(sums.T.tolist(), pa.list_(pa.float64())), pa.array(fall)], ["key", "resample", "n", "mean", "sums", "fall"])

    return met.select("key", "range", "bucket", "values", *about).mapInArrow(run, f"key {kind}, resample int, n long, mean double, sums array<double>, fall double")


def intervals(made: DataFrame, confidence: float = 0.95) -> DataFrame:
    """key, point, lo, hi, se, n_finite of samples (key, resample, value); values that aren't finite have no part in the interval."""
    tail = (1 - confidence) / 2
    finite = F.when((F.col("resample") >= 0) & ~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    return made.groupBy("key").agg(
        F.max(F.when(F.col("resample") == ORIGINAL, F.col("value"))).alias("point"), F.percentile(finite, F.lit(tail)).alias("lo"),
        F.percentile(finite, F.lit(1 - tail)).alias("hi"), F.stddev_samp(finite).alias("se"), F.count(finite).alias("n_finite"))


# Draws of single values


def weighted_samples(df: DataFrame, by: str, value: str, weight: str, order: str, metric: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """key, resample, value: a metric (not a path's) of the original and of n resamples that draw values in proportion to a weight.

    With the uniqueness of overlapping trades as weight this is the sequential bootstrap's interval. Rows without a weight weigh
    nothing; a group without any weight draws evenly. Each resample's draws are dealt to buckets by a multinomial, made once for a group;
    a bucket draws for all resamples, by Walker's alias table of its weights.
    """
    if metric == "max_drawdown":
        raise ValueError("draws of single values have no path")
    rows = positions(df, by, value, order, weight).withColumn("w", F.coalesce(F.col(weight).cast("double"), F.lit(0.0)))
    cells = rows.groupBy("key", F.floor(F.col("at") / BUCKET).cast("int").alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("at", "x", "w"))).alias("v"), F.sum("w").alias("w"), F.sum("x").alias("s"), F.count("*").alias("m"))
    whole = cells.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("bucket", "w", "m"))).alias("all"), (F.sum("s") / F.sum("m")).alias("mean"), F.sum("m").alias("n"))
    kind = cells.schema["key"].dataType.simpleString()

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in range(part.num_rows):
                bucket, all_w, all_m = (part.column(c)[r].values.to_numpy() for c in ("bucket", "all_w", "all_m"))
                size, mean = part.column("n")[r].as_py(), part.column("mean")[r].as_py()
                even = not all_w.sum()
                share = all_m / size if even else all_w / all_w.sum()
                counts = np.random.default_rng([seed, 0]).multinomial(size, share, n)
                for at in range(0, len(bucket), 512):
                    own = bucket[at : at + 512]
                    m = len(own)
                    dealt = pa.ListArray.from_arrays(np.arange(m + 1, dtype=np.int32) * n, pa.array(np.ascontiguousarray(counts[:, at : at + 512].T).reshape(-1)))
                    yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array([r] * m, pa.int64())), pa.array(own), pa.array([even] * m), pa.array([size] * m, pa.int64()), pa.array([mean] * m, pa.float64()), dealt], ["key", "bucket", "even", "n", "mean", "counts"])

    dealt = whole.select("key", F.col("all.bucket").alias("bucket"), F.col("all.w").alias("all_w"), F.col("all.m").alias("all_m"), "mean", "n").mapInArrow(deal, f"key {kind}, bucket int, even boolean, n long, mean double, counts array<long>")
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows = cells.select("key", "bucket", F.col("v.x").alias("x"), F.col("v.w").alias("w")).join(dealt, ["key", "bucket"]).repartition(tasks, "key", "bucket")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in range(part.num_rows):
                x, w, counts = (part.column(c)[r].values.to_numpy() for c in ("x", "w", "counts"))
                bucket, even, size, mean = (part.column(c)[r].as_py() for c in ("bucket", "even", "n", "mean"))
                rng, table = np.random.default_rng([seed, 1 + bucket]), alias_table(np.ones(len(x)) if even or not w.sum() else w)
                each = features(x - mean, mean).T
                sums = [each.sum(axis=0), *(np.bincount(alias_draws(table, int(c), rng), minlength=len(x)) @ each for c in counts)]
                own = [ORIGINAL, *range(n)]
                m = len(own)
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array([r] * m, pa.int64())), pa.array(own, pa.int32()), pa.array([size] * m, pa.int64()), pa.array([mean] * m, pa.float64()), *map(pa.array, np.array(sums).T)], ["key", "resample", "n", "mean", *(f"s{k}" for k in range(5))])

    parts = rows.select("key", "bucket", "x", "w", "even", "mean", "n", "counts").mapInArrow(run, f"key {kind}, resample int, n long, mean double, " + ", ".join(f"s{k} double" for k in range(5)))
    each = parts.groupBy("key", "resample", "n", "mean").agg(F.array(*(F.sum(f"s{k}") for k in range(5))).alias("sums"))
    done = F.pandas_udf(lambda m, mean, sums: pd.Series(finished(metric, m.to_numpy(float), mean.to_numpy(), np.array(sums.tolist(), float).reshape(-1, 5).T, np.zeros(len(m)))), "double")
    return each.select("key", "resample", done("n", "mean", "sums").alias("value"))


def alias_table(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walker's table of weights: cell i is i itself with a probability, else its alias."""
    n = len(w)
    p = (w * (n / w.sum())).tolist()
    chance, other = np.ones(n), np.arange(n)
    low, high = [i for i in range(n) if p[i] < 1], [i for i in range(n) if p[i] >= 1]
    while low and high:
        i, k = low.pop(), high[-1]
        chance[i], other[i] = p[i], k
        p[k] -= 1 - p[i]
        if p[k] < 1:
            low.append(high.pop())
    return chance, other


def alias_draws(table: tuple[np.ndarray, np.ndarray], many: int, rng: np.random.Generator) -> np.ndarray:
    """Places drawn in proportion to the table's weights."""
    chance, other = table
    place = rng.random(many) * len(chance)
    at = np.minimum(place.astype(np.int64), len(chance) - 1)
    place -= at
    return np.where(place < chance[at], at, other[at])


# PR-AUC


def shares(counts: np.ndarray, seed: int, resample: int, kind: int) -> np.ndarray:
    """How many of a class's draws fall into each bucket."""
    total = int(counts.sum())
    return counts if resample == ORIGINAL or not total else np.random.default_rng([seed, resample, kind]).multinomial(total, counts / total)


def pr_part(pos: np.ndarray, neg: np.ndarray, bucket: int, all_pos: np.ndarray, all_neg: np.ndarray, seed: int, resample: int) -> float:
    """What a bucket adds to the average precision of a resample that keeps the classes' sizes: levels by falling p, ties together."""
    drawn = []
    for kind, own, everywhere in ((0, pos, all_pos), (1, neg, all_neg)):
        share = shares(everywhere, seed, resample, kind)
        here = own if resample == ORIGINAL or not own.sum() else np.random.default_rng([seed, resample, 2 + 2 * bucket + kind]).multinomial(int(share[bucket]), own / own.sum())
        drawn.append((here, int(share[bucket + 1 :].sum())))
    (p, p_before), (q, q_before) = drawn
    hits, all_ = p_before + np.cumsum(p), p_before + q_before + np.cumsum(p + q)
    return float((p / max(1, int(all_pos.sum())) * hits / np.maximum(all_, 1)).sum())


def pr_auc_samples(df: DataFrame, by: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """key, resample, value: average precision of predictions (y, p) and of n resamples stratified by class.

    Counts of each distinct p are cut into buckets of LEVELS, by rank; a resample's draws are dealt to buckets by a multinomial that every
    task draws alike, so a bucket knows what stands above it. Groups without both classes have no rows.
    """
    counted, _ = metrics._tied(df.where("p IS NOT NULL AND y IS NOT NULL").withColumn("key", keyed(df, by)), ["key"])
    counted = counted.withColumn("__one", F.lit(1))
    ranked = metrics.running(counted, ["key"], "p", {"at": "__one"}, metrics.place(F.col("p"), metrics.cuts(counted, ["p"])[0]))
    cells = ranked.groupBy("key", F.floor(F.col("at") / LEVELS).cast("int").alias("bucket")).agg(F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("p"), "pos", "neg"))).alias("v"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    whole = cells.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("bucket", "pos", "neg"))).alias("all")).where("exists(all, b -> b.pos > 0) AND exists(all, b -> b.neg > 0)")
    kind = whole.schema["key"].dataType.simpleString()
    rows = cells.select("key", "bucket", F.col("v.pos").alias("pos"), F.col("v.neg").alias("neg")).join(whole.select("key", F.col("all.pos").alias("all_pos"), F.col("all.neg").alias("all_neg")), "key")
    rows = rows.withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(n // TOGETHER)))).repartition("key", "bucket", "range")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in range(part.num_rows):
                pos, neg, all_pos, all_neg = (part.column(c)[r].values.to_numpy() for c in ("pos", "neg", "all_pos", "all_neg"))
                own = _numbers(part.column("range")[r].as_py(), n)
                got = [pr_part(pos, neg, part.column("bucket")[r].as_py(), all_pos, all_neg, seed, b) for b in own]
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array([r] * len(own), pa.int64())), pa.array(own, pa.int32()), pa.array(got, pa.float64())], ["key", "resample", "value"])

    parts = rows.select("key", "bucket", "range", "pos", "neg", "all_pos", "all_neg").mapInArrow(run, f"key {kind}, resample int, value double")
    return parts.groupBy("key", "resample").agg(F.sum("value").alias("value"))


def named(made: DataFrame, by: str, *columns: str) -> DataFrame:
    """The key as a column of its name again."""
    return made.select(F.col("key.k").alias(by), *columns)

