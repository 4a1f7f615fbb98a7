"""Calibration, ranking and trading metrics as aggregates and windows.

Inputs of the prediction metrics: y (0/1), p, and where order matters idx; of the trading metrics: pnl,
entry_ts, exit_ts (ns), reason. `by` names the columns of the groups; without any, one row comes out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelorus.functions.scalars import NORMAL

ANY = "__all"
TINY = 1e-10
#: Rows of a group that one task's window has.
CHUNK = 100_000


def _grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn(ANY, F.lit(0)), [ANY])


def squared_error(y: str = "y", p: str = "p") -> Column:
    return (F.col(p) - F.col(y)) * (F.col(p) - F.col(y))


def brier() -> Column:
    """Aggregate: mean squared error; 0.0 without rows."""
    return F.coalesce(F.avg(squared_error()), F.lit(0.0))


def log_loss(clip: float = 1e-7) -> Column:
    p = F.least(F.greatest(F.col("p"), F.lit(clip)), F.lit(1 - clip))
    return F.avg(-F.col("y") * F.log(p) - (1 - F.col("y")) * F.log(1 - p))


def cuts(df: DataFrame, columns: Sequence[str], n: int | None = None) -> list[list[float]]:
    """About n - 1 approximate quantiles of each column, ascending: bounds of buckets of about equal size.

    Without n there are 128 buckets, or as many as hold about CHUNK rows each.
    """
    most = n or 128
    count, *row = df.agg(F.count("*"), *(F.percentile_approx(c, [k / most for k in range(1, most)], 100 * most) for c in columns)).first()
    if n is None and count > 4 * most * CHUNK:
        return cuts(df, columns, -(-count // CHUNK))
    return [sorted(set(x or [])) for x in row]


def join_by(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join by columns of the same names in which a null key meets null keys."""
    named = right.select(*(F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns))
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(named, on, how).drop(*(f"__r_{k}" for k in keys))


def place(value: Column, bounds: Sequence[float]) -> Column:
    """Twice the number of bounds below value, one more if it is a bound: odd buckets hold a single value."""
    if not bounds:
        return F.lit(0)
    each = F.array(*map(F.lit, bounds))
    return 2 * F.size(F.filter(each, lambda b: b < value)) + F.array_contains(each, value).cast("int")


def bucketed(df: DataFrame, falling: bool = False) -> tuple[Column, Column]:
    """Two buckets: one that never falls as p grows, and one that never falls as (p, idx) grows, or as (-p, idx) does.

    A p that many rows share has many of the latter, by idx.
    """
    by_p, by_idx = cuts(df, ["p", "idx"])
    at = place(F.col("p"), by_p)
    return at, F.struct((-at if falling else at).alias("p"), F.when(at % 2 == 1, place(F.col("idx"), by_idx)).otherwise(0).alias("i"))


def quantiles(df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles of each group (an array `quantiles`); rows without a value don't count.

    Values are counted, and ranked bucket by bucket, so no task holds the values of a group.
    """
    df, keys = _grouped(df, by)
    counted = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
    ranked = running(counted, keys, "__v", {"__below": "__n"}, place(F.col("__v"), cuts(counted, ["__v"])[0]))
    sizes = counted.groupBy(*keys).agg((F.sum("__n") - 1).alias("__last"))
    at = lambda k: F.max(F.when((F.col("__below") <= k) & (k < F.col("__below") + F.col("__n")), F.col("__v")))
    place_of = [F.col("__last") * F.lit(float(s)) for s in shares]
    found = join_by(ranked, sizes, keys).groupBy(*keys, "__last").agg(*(at(f(x)).alias(f"__{side}{i}") for i, x in enumerate(place_of) for side, f in (("lo", F.floor), ("hi", F.ceil))))
    made = [F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (x - F.floor(x)) for i, x in enumerate(place_of)]
    out = found.select(*keys, F.array(*made).alias("quantiles"))
    return out if by else out.drop(ANY)


def with_bins(df: DataFrame, n_bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """bin: how many inner quantile edges of p (within the group) are at most p; equal p share a bin."""
    df, by = _grouped(df, by)
    edges = quantiles(df, "p", [k / n_bins for k in range(1, n_bins)], by).withColumnRenamed("quantiles", "__edges")
    return join_by(df, edges, by).withColumn("bin", F.size(F.filter("__edges", lambda e: e <= F.col("p")))).drop("__edges")


def histogram_bin(p: str, n: int = 20) -> Column:
    """The bin of a probability among n of equal width; 1 is in the last."""
    return F.least(F.lit(n - 1), F.floor(F.col(p) * n)).cast("int")


def reliability(df: DataFrame, n_bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """p_mean, y_mean and n of each bin that has rows."""
    _, keys = _grouped(df, by)
    out = with_bins(df, n_bins, by).groupBy(*keys, "bin").agg(F.avg("p").alias("p_mean"), F.avg("y").alias("y_mean"), F.count("*").alias("n"))
    return out if by else out.drop(ANY)


def ece(df: DataFrame, n_bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error over quantile bins."""
    bins = reliability(df, n_bins, by)
    bins, keys = _grouped(bins, by)
    out = bins.groupBy(*keys).agg((F.sum(F.abs(F.col("p_mean") - F.col("y_mean")) * F.col("n")) / F.sum("n")).alias("ece"))
    return out if by else out.drop(ANY)


def by_regime(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """Brier and ECE of each regime with two rows or more; edges are the regime's own."""
    score = df.groupBy("regime").agg(F.count("*").alias("n"), brier().alias("brier")).where("n >= 2")
    return score.join(ece(df, n_bins, ["regime"]), "regime")


def _tied(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Counts of positives and negatives of each distinct p: all that ranks need, and small where p repeats."""
    df, by = _grouped(df, by)
    return df.groupBy(*by, "p").agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") == 0).cast("long")).alias("neg")), by


def running(df: DataFrame, by: Sequence[str], order: str, values: dict[str, str], bucket: Column | None = None) -> DataFrame:
    """Sums of columns over all rows of the group before this one by `order` (distinct): {name: column}.

    With bucket, a column that never falls as `order` grows, rows are sorted within buckets only, and
    the buckets' totals are summed up on their own; so one group spreads over many tasks.
    """
    if bucket is None:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in values.items()})
    df = df.withColumn("__bucket", bucket)
    inner = Window.partitionBy(*by, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, "__bucket").agg(*(F.sum(c).alias(f"__t_{n}") for n, c in values.items()))
    totals = totals.select(*by, "__bucket", *(F.coalesce(F.sum(f"__t_{n}").over(outer), F.lit(0)).alias(f"__b_{n}") for n in values))
    df = join_by(df, totals, [*by, "__bucket"])
    out = df.withColumns({n: F.coalesce(F.sum(c).over(inner), F.lit(0)) + F.col(f"__b_{n}") for n, c in values.items()})
    return out.drop("__bucket", *(f"__b_{n}" for n in values))


def roc_auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney with average ranks; 0.5 where a class lacks."""
    tied, keys = _tied(df, by)
    ranked = running(tied, keys, "p", {"below": "neg"}, place(F.col("p"), cuts(tied, ["p"])[0]))
    out = ranked.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    )
    value = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos") * F.col("n_neg"))).otherwise(0.5)
    out = out.select(*keys, "n_pos", "n_neg", value.alias("roc_auc"))
    return out if by else out.drop(ANY)


def pr_auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision by falling p; of equal p the smaller idx comes first. 0 without positives."""
    df, keys = _grouped(df, by)
    df = df.withColumns({"__order": F.struct((-F.col("p")).alias("p"), F.col("idx").alias("i")), "__one": F.lit(1)})
    ranked = running(df, keys, "__order", {"hits": "y", "rows": "__one"}, bucketed(df, falling=True)[1])
    precision = (F.col("hits") + F.col("y")) / (F.col("rows") + 1)
    out = ranked.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("y") == 1, precision)) / F.sum("y"), F.lit(0.0)).alias("pr_auc"))
    return out if by else out.drop(ANY)


def delong(df: DataFrame, confidence: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC with DeLong's variance and interval. Ranks within a class go by idx where p is tied."""
    df, keys = _grouped(df, by)
    of_p, bucket = bucketed(df)
    tied = running(df.groupBy(*keys, "p").agg(F.count("*").alias("__n")), keys, "p", {"__below": "__n"}, of_p)
    rows = join_by(df, tied, [*keys, "p"]).withColumn("__mid", F.col("__below") + (F.col("__n") + 1) / 2)
    rows = rows.withColumns({"__order": F.struct("p", "idx"), "__one": F.lit(1)})
    rows = running(rows, [*keys, "y"], "__order", {"__before": "__one"}, bucket)
    sizes = df.groupBy(*keys).agg(F.sum("y").alias("__np"), F.sum(1 - F.col("y")).alias("__nn"))
    rows = join_by(rows, sizes, keys).withColumn("__place", F.col("__mid") - F.col("__before") - 1)
    share = F.when(F.col("y") == 1, F.col("__place") / F.col("__nn")).otherwise(1 - F.col("__place") / F.col("__np"))
    out = rows.withColumn("__v", share).groupBy(*keys).agg(
        F.sum(F.when(F.col("y") == 1, F.col("__mid"))).alias("__ranks"), F.first("__np").alias("n_pos"), F.first("__nn").alias("n_neg"),
        F.var_samp(F.when(F.col("y") == 1, F.col("__v"))).alias("__s10"), F.var_samp(F.when(F.col("y") == 0, F.col("__v"))).alias("__s01"),
    )
    z = NORMAL.inv_cdf(0.5 + confidence / 2)
    auc = (F.col("__ranks") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))
    var = F.col("__s10") / F.col("n_pos") + F.col("__s01") / F.col("n_neg")
    out = out.select(*keys, "n_pos", "n_neg", auc.alias("auc"), var.alias("variance"))
    out = out.withColumns({"lo": F.greatest(F.lit(0.0), F.col("auc") - z * F.sqrt("variance")), "hi": F.least(F.lit(1.0), F.col("auc") + z * F.sqrt("variance"))})
    return out if by else out.drop(ANY)


def wilson(successes: Column, total: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Wilson's interval for a share; (0, 1) without trials."""
    z = NORMAL.inv_cdf(0.5 + confidence / 2)
    p, n = successes / total, total
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(1.0)


def rolling_brier(df: DataFrame, window: int = 1000, by: Sequence[str] = ()) -> DataFrame:
    """rolling_brier: trailing mean over `window` rows by idx (distinct), null before there are as many; baseline: over all rows.

    Rows are numbered bucket by bucket and cut into chunks, each with the rows before it that its means
    need, so a group spreads over many tasks.
    """
    df, keys = _grouped(df, by)
    base = df.groupBy(*keys).agg(F.avg(squared_error()).alias("baseline"))
    names, length = df.columns, max(CHUNK, 4 * window)
    rows = running(df.withColumn("__one", F.lit(1)), keys, "idx", {"__at": "__one"}, place(F.col("idx"), cuts(df, ["idx"])[0]))
    rows = rows.withColumn("__chunk", F.floor(F.col("__at") / length)).withColumn("__own", F.lit(True))
    late = rows.where(F.col("__at") % length > length - window).withColumns({"__chunk": F.col("__chunk") + 1, "__own": F.lit(False)})
    near = Window.partitionBy(*keys, "__chunk").orderBy("idx").rowsBetween(-(window - 1), 0)
    rows = rows.union(late).withColumn("rolling_brier", F.when(F.col("__at") >= window - 1, F.avg(squared_error()).over(near))).where("__own")
    out = join_by(rows, base, keys).select(*names, "rolling_brier", "baseline")
    return out if by else out.drop(ANY)


def crossings(df: DataFrame, value: str, threshold: Column, by: Sequence[str] = ()) -> DataFrame:
    """How often the value rises from at most the threshold (or from null) to above it, by idx.

    Rises are counted within buckets of idx, and at buckets' heads from the last row of the bucket before.
    """
    df, keys = _grouped(df, by)
    df = df.withColumns({"__above": F.coalesce(F.col(value) > threshold, F.lit(False)), "__bucket": place(F.col("idx"), cuts(df, ["idx"])[0])})
    before = F.lag("__above").over(Window.partitionBy(*keys, "__bucket").orderBy("idx"))
    parts = df.withColumn("__up", F.col("__above") & ~before).groupBy(*keys, "__bucket").agg(F.count_if("__up").alias("__n"), F.min_by("__above", "idx").alias("__first"), F.max_by("__above", "idx").alias("__last"))
    head = F.col("__first") & ~F.coalesce(F.lag("__last").over(Window.partitionBy(*keys).orderBy("__bucket")), F.lit(False))
    out = parts.withColumn("__head", head.cast("long")).groupBy(*keys).agg((F.sum("__n") + F.sum("__head")).alias("crossings"))
    return out if by else out.drop(ANY)


def spans(df: DataFrame, flag: str, by: Sequence[str] = ()) -> DataFrame:
    """Runs of a true flag by idx: start, end (exclusive, in row numbers from 0)."""
    df, keys = _grouped(df, by)
    df = df.withColumns({"__one": F.lit(1), "__set": F.coalesce(F.col(flag), F.lit(False)).cast("int")})
    rows = running(df, keys, "idx", {"__at": "__one", "__nth": "__set"}, place(F.col("idx"), cuts(df, ["idx"])[0])).where("__set = 1")
    out = rows.groupBy(*keys, (F.col("__at") - F.col("__nth")).alias("__island")).agg(F.min("__at").cast("long").alias("start"), (F.max("__at") + 1).cast("long").alias("end")).drop("__island")
    return out if by else out.drop(ANY)


def equity(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative pnl by (exit_ts, idx), its high-water mark and the drawdown.

    Paths run within buckets of exit_ts; what a bucket adds is its sum and its highest point, so one series spreads over many tasks.
    """
    df, keys = _grouped(df, by)
    names = df.columns
    df = df.withColumn("__bucket", place(F.col("exit_ts"), cuts(df, ["exit_ts"])[0]))
    w = Window.partitionBy(*keys, "__bucket").orderBy("exit_ts", "idx").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__s", F.sum("pnl").over(w)).withColumn("__m", F.max("__s").over(w))
    past = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy(*keys, "__bucket").agg(F.sum("pnl").alias("__sum"), F.max("__m").alias("__top"))
    parts = parts.withColumn("__before", F.coalesce(F.sum("__sum").over(past), F.lit(0.0)))
    parts = parts.withColumn("__high", F.max(F.col("__before") + F.col("__top")).over(past)).drop("__sum", "__top")
    df = join_by(df, parts, [*keys, "__bucket"]).withColumn("equity", F.col("__before") + F.col("__s"))
    df = df.withColumn("high_water", F.greatest("__high", F.col("__before") + F.col("__m"))).withColumn("drawdown", F.col("high_water") - F.col("equity"))
    df = df.select(*names, "equity", "high_water", "drawdown")
    return df if by else df.drop(ANY)


def cdar(df: DataFrame, tail: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """max_drawdown (as a loss, <= 0) and the mean of the worst max(1, int(tail n)) drawdowns, negative. Drawdowns are ranked by their counts, in buckets."""
    df, keys = _grouped(df, by)
    counted = equity(df, keys).groupBy(*keys, (-F.col("drawdown")).alias("__d")).agg(F.count("*").alias("__n"))
    ranked = running(counted, keys, "__d", {"__before": "__n"}, place(F.col("__d"), cuts(counted, ["__d"])[0]))
    sizes = counted.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(F.sum("__n") * tail)).alias("__k"), F.min("__d").alias("max_drawdown"))
    taken = F.greatest(F.lit(0), F.least(F.col("__n"), F.col("__k") - F.col("__before")))
    out = join_by(ranked, sizes, keys).groupBy(*keys, "max_drawdown").agg((F.sum(taken * F.col("__d")) / F.sum(taken)).alias("cdar"))
    return out if by else out.drop(ANY)


def trading(df: DataFrame, m_minutes: int = 20, by: Sequence[str] = (), corrected: bool = False) -> DataFrame:
    """Counts, rates and risk-adjusted returns of closed trades.

    trades_per_year divides bars of a year by the mean holding time in minutes, as the published
    figures do; corrected=True takes minutes of a year. Ratios are null where they have no meaning.
    """
    df, keys = _grouped(df, by)
    hold = F.greatest(F.lit(1.0), (F.col("exit_ts") - F.col("entry_ts")) / 60e9)
    x = F.col("pnl")
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n_trades"), F.count_if(F.col("reason") == "TP").alias("n_tp"), F.count_if(F.col("reason") == "SL").alias("n_sl"),
        F.avg((x > 0).cast("double")).alias("hit_rate"), F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(x <= 0, x)), F.lit(0.0)).alias("avg_loss"),
        F.sum(F.when(x > 0, x).otherwise(0.0)).alias("__won"), F.sum(F.when(x <= 0, -x).otherwise(0.0)).alias("__lost"), F.sum(x).alias("total_log"),
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("__sd"), F.skewness(x).alias("__skew"), (F.kurtosis(x) + 3).alias("__kurt"),
        F.count_if(x < 0).alias("__losses"), F.stddev_samp(F.when(x < 0, x)).alias("__down"), F.avg(hold).alias("mean_hold_minutes"),
    )
    year = 525_600.0 / (1 if corrected else m_minutes)
    n, sr = F.col("n_trades"), F.when(F.col("__sd") > TINY, F.col("mean") / F.col("__sd"))
    out = out.withColumns({"trades_per_year": year / F.col("mean_hold_minutes"), "sharpe_per_trade": sr})
    sr = F.col("sharpe_per_trade")
    skew, kurt = F.when(n > 3, F.col("__skew")).otherwise(0.0), F.when(n > 3, F.col("__kurt")).otherwise(3.0)
    out = out.withColumns(
        {
            "profit_factor": F.when(F.col("__lost") > 0, F.col("__won") / F.col("__lost")),
            "total_pct": F.exp("total_log") - 1,
            "sharpe": sr * F.sqrt("trades_per_year"),
            "sortino": F.when((F.col("__losses") >= 2) & (F.col("__down") > TINY), F.col("mean") / F.col("__down") * F.sqrt("trades_per_year")),
            "psr_z": F.when(n > 1, sr * F.sqrt(n - 1) / F.sqrt(F.greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, F.lit(1e-12)))),
        }
    )
    out = out.drop("__won", "__lost", "__sd", "__skew", "__kurt", "__losses", "__down")
    return out if by else out.drop(ANY)


def normal_cdf(z: Column) -> Column:
    """Phi by the complementary error function's series in Horner form (Numerical Recipes' erfcc): relative error below 1.2e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(0.17087277)
    for a in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + a
    tail = t * F.exp(-x * x + poly) / 2
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def probabilistic_sharpe(sharpe: float, n: int, skew: float = 0.0, kurt: float = 3.0, benchmark: float = 0.0) -> float:
    if n <= 1:
        return 0.5
    return NORMAL.cdf((sharpe - benchmark) * math.sqrt(n - 1) / math.sqrt(max(1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2, 1e-12)))


def deflated_sharpe(sharpe: float, var_trials: float, n_trials: int, n: int, skew: float = 0.0, kurt: float = 3.0) -> tuple[float, float]:
    """Probability that the Sharpe ratio beats the expected maximum of n_trials, and that maximum."""
    gamma = 0.5772156649015329
    best = 0.0
    if n_trials > 1:
        best = math.sqrt(var_trials) * ((1 - gamma) * NORMAL.inv_cdf(1 - 1 / n_trials) + gamma * NORMAL.inv_cdf(1 - 1 / (n_trials * math.e)))
    return probabilistic_sharpe(sharpe, n, skew, kurt, best), best


def batched_exits(df: DataFrame) -> DataFrame:
    """Exits beyond the first at each exit_ts, summed."""
    each = df.groupBy("exit_ts").agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("batched_exits"))


def hold_ages(df: DataFrame) -> DataFrame:
    """Holding times in minutes by reason."""
    age = (F.col("exit_ts") - F.col("entry_ts")) / 60e9
    return df.groupBy("reason").agg(F.count("*").alias("n"), F.avg(age).alias("mean_age"), F.max(age).alias("max_age"))
