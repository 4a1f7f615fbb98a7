"""The adaptive threshold controller as an ordered fold, and warm-up calibration."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class ControllerConfig:
    tau0: float = 0.5
    alpha: float = 0.05
    gamma: float = 0.02
    dtau_max: float = 0.01
    tau_floor: float = 0.05
    tau_ceil: float = 0.95
    r_min: float = 0.4
    r_resume: float = 0.5
    r0: float = 0.5
    sigma_max: float | None = None


def step(cfg: ControllerConfig, state: Column, x: Column) -> Column:
    """One bar: r_hat follows entries, r_star matured labels (with pause and resume), tau their difference."""
    r_hat = (1 - cfg.alpha) * state["r_hat"] + cfg.alpha * x["entered"].cast("double")
    y = x["label"].cast("double")
    r_star = F.when(x["label"].isNull(), state["r_star"]).otherwise((1 - cfg.alpha) * state["r_star"] + cfg.alpha * y)
    paused = F.when(x["label"].isNull(), state["paused"]).when(state["paused"], ~(r_star > cfg.r_resume)).otherwise(r_star < cfg.r_min)
    move = F.greatest(F.lit(-cfg.dtau_max), F.least(F.lit(cfg.dtau_max), cfg.gamma * (r_hat - r_star)))
    tau = F.greatest(F.lit(cfg.tau_floor), F.least(F.lit(cfg.tau_ceil), state["tau"] + move))
    return F.struct(F.when(paused, state["tau"]).otherwise(tau).alias("tau"), r_hat.alias("r_hat"), r_star.alias("r_star"), paused.alias("paused"))


def fold_array(df: DataFrame, cfg: ControllerConfig = ControllerConfig(), by: str = "instrument", order: str = "bar") -> DataFrame:
    """Final state of each series of (bar, entered, label): an exact fold over its rows in order, in the JVM.

    A series' rows meet in one array, so this is for series of up to some million bars.
    """
    rows = df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, "entered", "label"))).alias("rows"))
    start = F.struct(F.lit(cfg.tau0).alias("tau"), F.lit(cfg.r0).alias("r_hat"), F.lit(cfg.r0).alias("r_star"), F.lit(False).alias("paused"))
    return rows.select(by, F.aggregate("rows", start, lambda s, x: step(cfg, s, x)).alias("s")).select(by, "s.*")


@dataclasses.dataclass
class State:
    """The controller between two bars; the same step as `step`, in Python."""

    tau: float
    r_hat: float
    r_star: float
    paused: bool = False

    def step(self, c: ControllerConfig, entered: float, label: float | None) -> None:
        self.r_hat = (1 - c.alpha) * self.r_hat + c.alpha * entered
        if label is not None:
            self.r_star = (1 - c.alpha) * self.r_star + c.alpha * label
            self.paused = not self.r_star > c.r_resume if self.paused else self.r_star < c.r_min
        if not self.paused:
            self.tau = min(c.tau_ceil, max(c.tau_floor, self.tau + max(-c.dtau_max, min(c.dtau_max, c.gamma * (self.r_hat - self.r_star)))))


def fold(df: DataFrame, cfg: ControllerConfig = ControllerConfig(), by: str = "instrument", order: str = "bar") -> DataFrame:
    """The same for series of any length: rows come to a task sorted, batch by batch, and only the state is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, done = None, None, []
        last = lambda: (now, state.tau, state.r_hat, state.r_star, state.paused)
        for part in batches:
            for key, entered, label in zip(part[by].tolist(), part["entered"].tolist(), part["label"].tolist()):
                if state is None or key != now:
                    if state is not None:
                        done.append(last())
                    now, state = key, State(cfg.tau0, cfg.r0, cfg.r0)
                state.step(cfg, float(entered), None if label is None or label != label else float(label))
            if len(done) > 10_000:
                yield pd.DataFrame(done, columns=[by, "tau", "r_hat", "r_star", "paused"])
                done = []
        if state is not None:
            done.append(last())
        yield pd.DataFrame(done, columns=[by, "tau", "r_hat", "r_star", "paused"])

    rows = df.select(by, order, F.col("entered").cast("double").alias("entered"), F.col("label").cast("double").alias("label"))
    ordered = rows.repartition(by).sortWithinPartitions(by, order)
    return ordered.mapInPandas(run, f"{by} {dict(df.dtypes)[by]}, tau double, r_hat double, r_star double, paused boolean")


def should_enter(p: Column, sigma: Column, tau: Column, paused: Column, sigma_max: Column) -> Column:
    return ~paused & (sigma.isNull() | (sigma <= sigma_max)) & (p >= tau)


def calibrate(df: DataFrame, by: str = "instrument", q_sigma: float = 0.75, window: int = 50, threshold: float = 0.05, least: int = 100, most: int = 2000, tau_floor: float = 0.0) -> DataFrame:
    """Warm-up calibration from (idx, y, p, sigma): the bars until the rolling Brier score is stable, and what they say.

    n_used, sigma_max (quantile of sigma; infinite where all are 0), r_star (mean y), tau (the 1 - r_star quantile of p, not below the floor).
    """
    w = Window.partitionBy(by).orderBy("idx")
    df = df.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= most)
    err = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    df = df.withColumn("__b", F.when(F.col("__nth") >= window, F.avg(err).over(w.rowsBetween(-(window - 1), 0))))
    before = F.lag("__b", window).over(w)
    df = df.withColumn("__stable", (F.col("__nth") >= least) & (before > 0) & (F.abs(F.col("__b") - before) / before < threshold))
    stop = df.groupBy(by).agg(F.coalesce(F.min(F.when(F.col("__stable"), F.col("__nth"))), F.max("__nth")).alias("n_used"))
    used = df.join(stop, by).where(F.col("__nth") <= F.col("n_used"))
    rate = used.groupBy(by).agg(F.avg("y").alias("r_star"), F.max("n_used").alias("n_used"), F.percentile("sigma", q_sigma).alias("__q"), F.max("sigma").alias("__top"), F.sort_array(F.collect_list("p")).alias("__p"))
    at = (F.size("__p") - 1) * (1 - F.col("r_star"))
    low, high = F.get("__p", F.floor(at).cast("int")), F.get("__p", F.ceil(at).cast("int"))
    tau = F.greatest(F.lit(tau_floor), low + (high - low) * (at - F.floor(at)))
    return rate.select(by, "n_used", F.when(F.col("__top") > 0, F.col("__q")).otherwise(float("inf")).alias("sigma_max"), "r_star", tau.alias("tau"))
