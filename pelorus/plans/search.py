"""Window search, folds and acceptance."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def tent(x: Column, lo: float, peak: float, hi: float) -> Column:
    """1 at the peak, falling to 0 at lo and hi."""
    return F.when(x.isNull() | (x <= lo) | (x >= hi), 0.0).when(x <= peak, (x - lo) / (peak - lo)).otherwise((hi - x) / (hi - peak))


def bracket(x: Column, lo: float, hi: float) -> Column:
    """1 within [lo, hi], falling off outside in proportion."""
    return F.when(x < lo, F.greatest(F.lit(0.0), x / lo)).when(x > hi, F.greatest(F.lit(0.0), hi / x)).otherwise(1.0)


def window_scores(df: DataFrame, days: int = 14, slide: int = 1, rate: tuple[float, float, float] = (0.05, 0.10, 0.15), span: tuple[float, float] = (1.5, 3.0), by: str = "instrument") -> DataFrame:
    """Sliding windows of labelled bars (open_time, label, return, parkinson_var) within the event-rate band, scored.

    Windows start a whole number of days after the first row, so each day is summed up once, and it is the
    days that go to the windows that hold them (days / slide of them).
    Score: .45 event rate, .25 balance of up and down, .20 variation and .10 span of the Parkinson variance.
    """
    edges = df.groupBy(by).agg(F.min("open_time").alias("__min"), F.max("open_time").alias("__max"))
    length = days * DAY_MS
    r, pv = F.col("return"), F.col("parkinson_var")
    pos = F.when(pv > 0, pv)
    day = F.floor((F.col("open_time") - F.col("__min")) / DAY_MS)
    each = df.join(edges, by).groupBy(by, "__min", "__max", day.alias("__day")).agg(
        F.count("label").alias("n"), F.sum("label").alias("hits"), F.count_if(r > 0).alias("up"), F.count_if(r != 0).alias("moved"),
        F.count(pos).alias("np"), F.avg(pos).alias("mean"), F.var_pop(pos).alias("var"), F.max(pos).alias("high"), F.min(pos).alias("low"),
    )
    first = F.greatest(F.lit(0), F.ceil((F.col("__day") - days + 1) / slide))
    rows = each.withColumn("k", F.explode(F.sequence(first, F.floor(F.col("__day") / slide)))) if slide <= days else each.withColumn("k", F.floor(F.col("__day") / slide)).where(F.col("__day") - F.col("k") * slide < days)
    rows = rows.withColumn("start", F.col("__min") + F.col("k") * slide * DAY_MS).where(F.col("start") <= F.col("__max") - length)
    whole = F.sum(F.col("np") * F.col("mean")) / F.sum("np")
    out = rows.groupBy(by, "start").agg(
        F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("event_rate"), F.when(F.sum("moved") > 0, F.sum("up") / F.sum("moved")).alias("up_frac"), whole.alias("__mean"),
        (F.sum(F.col("np") * (F.col("var") + F.col("mean") * F.col("mean"))) / F.sum("np") - whole * whole).alias("__var"), F.coalesce(F.max("high") / F.min("low"), F.lit(1.0)).alias("parkinson_span"),
    )
    out = out.withColumn("parkinson_cv", F.coalesce(F.sqrt(F.greatest(F.lit(0.0), F.col("__var"))) / F.col("__mean"), F.lit(0.0))).drop("__mean", "__var")
    lo, ideal, hi = rate
    out = out.where((F.col("event_rate") >= lo) & (F.col("event_rate") <= hi)).withColumn("up_frac", F.coalesce("up_frac", F.lit(0.5)))
    score = 0.45 * tent(F.col("event_rate"), lo, ideal, hi) + 0.25 * (1 - F.abs(F.col("up_frac") - 0.5) * 2) + 0.20 * F.least(F.lit(1.0), F.col("parkinson_cv")) + 0.10 * bracket(F.col("parkinson_span"), *span)
    return out.withColumn("end", F.col("start") + length).withColumn("score", score)


def best_windows(df: DataFrame, n_top: int = 5, by: str = "instrument", **kwargs) -> DataFrame:
    """The n_top windows of each instrument by score, then start."""
    ranked = window_scores(df, by=by, **kwargs).withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "start")))
    return ranked.where(F.col("rank") <= n_top)


def purged_folds(spark: SparkSession, n: int, n_folds: int = 10, n_test: int = 2, purge: int = 1, embargo: int = 5) -> DataFrame:
    """Combinatorial purged folds over rows 0 .. n-1: split, test blocks, and the train ranges left.

    Rows: split, kind (test or train), first, behind. Train rows within `purge` of a test block or `embargo` after it are out.
    """
    bounds = [n * k // n_folds for k in range(n_folds + 1)]
    rows = []
    for split, chosen in enumerate(itertools.combinations(range(n_folds), n_test)):
        out = [False] * n_folds
        cuts: list[tuple[int, int]] = []
        for k in chosen:
            out[k] = True
            rows.append((split, "test", bounds[k], bounds[k + 1]))
            cuts.append((bounds[k] - purge, bounds[k + 1] + purge + embargo))
        at = 0
        for a, b in sorted(cuts):
            if at < a:
                rows.append((split, "train", at, a))
            at = max(at, b)
        if at < n:
            rows.append((split, "train", at, n))
    return spark.createDataFrame(rows, "split int, kind string, first long, behind long")


def fold_summary(metrics: DataFrame) -> DataFrame:
    """Of per-fold rows (sharpe, n_trades): mean Sharpe, its 5/50/95 % band, trades."""
    q = F.percentile("sharpe", [0.05, 0.5, 0.95])
    return metrics.agg(F.count("*").alias("n_folds"), F.avg("sharpe").alias("mean_sharpe"), F.sum("n_trades").alias("n_trades"), q.alias("__q")).select("n_folds", "mean_sharpe", "n_trades", F.col("__q")[0].alias("p05"), F.col("__q")[1].alias("p50"), F.col("__q")[2].alias("p95"))


def failed_gates(metrics: dict, min_trades: int | None = None, sharpe_floor: float | None = None, max_seed_gap: float | None = None) -> list[str]:
    """Reasons against accepting an experiment."""
    out = []
    if min_trades is not None and metrics.get("n_trades", 0) < min_trades:
        out.append(f"{metrics.get('n_trades', 0)} trades, fewer than {min_trades}")
    if sharpe_floor is not None:
        if (metrics.get("sharpe") or 0.0) < sharpe_floor:
            out.append(f"Sharpe {metrics.get('sharpe')} below {sharpe_floor}")
        lo = (metrics.get("sharpe_ci") or (None, None))[0]
        if lo is None or lo <= 0:
            out.append("the Sharpe interval doesn't lie above 0")
    band = metrics.get("seed_band")
    if max_seed_gap is not None and band and band["med"] - band["lo"] > max_seed_gap:
        out.append(f"seeds differ by {band['med'] - band['lo']:.3g}")
    return out
