"""Experiments: a backtest or cross-validation from a spec, its metrics, and its report as tables and JSON."""

from __future__ import annotations

import datetime
import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.functions import metrics, stats
from pelorus.operators import bars as B
from pelorus.operators import controller, features, offline, regime, simulate
from pelorus.plans import search
from pelorus.plans.config import CVConfig, ExperimentSpec, ModelConfig
from pelorus.plans.pipeline import table_hash
from pelorus.sources import files, minutes

#: Sections of a report in their order.
SECTIONS = ("overview", "calibration", "controller", "trading", "inventory", "operational", "drift", "coverage", "spec")


def chosen(model: ModelConfig) -> list[features.FeatureSpec]:
    """The features that the online model learns from.

    By importance, if there is a file of it; else the means of 8 bars come first, of one source after the
    other, then the rest of the catalog in its order.
    """
    catalog = features.default_catalog()
    if model.importance_path:
        catalog = features.by_importance(catalog, minutes.read_importance(model.importance_path))
    else:
        catalog.sort(key=lambda s: not (s.stat == "mean" and s.window == 8))
    return catalog[: model.n_features]


def prepare(spark: SparkSession, spec: ExperimentSpec, rows: DataFrame | None = None) -> tuple[DataFrame, tuple[str, ...]]:
    """Bars with features, regime and p_offline, and the names that the online model learns from."""
    d = spec.data
    rows = minutes.valid_rows(minutes.read_minutes(spark, d.path, d.start_ms, d.end_ms) if rows is None else rows)
    bars = B.count_bars(rows, d.m_minutes)
    specs = chosen(spec.model)
    tercile = features.FeatureSpec("parkinson_var_rolling_mean_24", "parkinson_var", "mean", 24)
    df = features.build(features.base_features(bars), specs if tercile in specs else [*specs, tercile])
    try:
        df = df.withColumn("regime", regime.volatility_terciles(df).assign())
    except ValueError:  # too few bars for an edge
        df = df.withColumn("regime", F.lit(0))
    df = df.withColumn("p", F.lit(0.5))
    if spec.model.offline_path:
        df = offline.score(df, offline.load(spark, spec.model.offline_path, spec.model.offline_members))
        df = df.withColumn("p", F.col("p_offline"))
    return df, tuple(s.name for s in specs)


def backtest(spark: SparkSession, spec: ExperimentSpec, rows: DataFrame | None = None, own: DataFrame | None = None) -> dict[str, DataFrame]:
    """Named tables of a run: outputs, fills, trace, state, audit, drift.

    own: strategy parameters of each instrument (instrument, and a column for each), in place of the spec's.
    """
    df, names = prepare(spark, spec, rows)
    if own is not None:
        df = df.join(own, "instrument", "left")
    out = simulate.simulate(df, spec.sim(names), tuple(c for c in own.columns if c != "instrument") if own is not None else ())
    return named(out)


def named(out: DataFrame) -> dict[str, DataFrame]:
    of = lambda kind: out.where(F.col("kind") == kind)
    return {"outputs": out, "fills": simulate.fills(out), "trace": simulate.trace(out), "state": of("state"), "audit": of("audit"), "drift": of("drift")}


def battery(tables: dict[str, DataFrame], m_minutes: int, n_resamples: int = 500, trials: tuple[int, float] = (1, 0.0)) -> dict:
    """The metrics of a run as one dictionary of blocks.

    trials: how many strategies were tried before this one, and the variance of their Sharpe ratios, by which its own is deflated.
    """
    trace, fills, state = tables["trace"], tables["fills"], tables["state"]
    row = lambda df: {k: None if isinstance(v, float) and not math.isfinite(v) else v for k, v in (df.first().asDict() if df.columns else {}).items()}
    calibration = row(trace.agg(F.count("*").alias("n"), metrics.brier().alias("brier"), F.avg("y").alias("base_rate")))
    if calibration["n"]:
        calibration |= row(metrics.ece(trace)) | row(metrics.roc_auc(trace)) | row(metrics.pr_auc(trace))
        calibration["intervals"] = stats.calibration_intervals(trace, "instrument", "idx", n=n_resamples)
        calibration["roc_auc_ci"] = [row(metrics.delong(trace)).get(k) for k in ("lo", "hi")]
        calibration["regimes"] = [r.asDict() for r in metrics.by_regime(trace).orderBy("regime").collect()]
        calibration["reliability"] = [r.asDict() for r in metrics.reliability(trace).orderBy("bin").collect()]
    trading = row(metrics.trading(fills, m_minutes))
    if trading.get("n_trades"):
        trading |= row(metrics.cdar(fills))
        trading["psr"] = metrics.NORMAL.cdf(trading["psr_z"]) if trading.get("psr_z") is not None else 0.5
        lo, hi = stats.sharpe_interval(fills, "instrument", ["exit_ts", "idx"], "pnl", n=n_resamples)
        trading["deflated_sharpe"], trading["expected_best_sharpe"] = metrics.deflated_sharpe(trading.get("sharpe") or 0.0, trials[1], trials[0], trading["n_trades"])
        trading["sharpe_ci"] = (lo, hi) if math.isfinite(lo) else (None, None)
        trading |= row(metrics.batched_exits(fills))
    spans = metrics.spans(state.select("instrument", F.col("ts").alias("idx"), "paused"), "paused", ["instrument"])
    last = row(state.agg(F.max_by("tau", "ts").alias("tau"), F.max("size").alias("max_inventory"), F.avg("size").alias("mean_inventory"), F.min("drawdown").alias("worst_drawdown"), F.count("*").alias("n_bars")))
    last |= row(spans.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("paused_bars"), F.count("*").alias("pauses")))
    rolled = metrics.rolling_brier(trace, 200, ["instrument"])
    drift = row(rolled.agg(F.max("rolling_brier").alias("worst_rolling_brier"), F.avg("baseline").alias("baseline")))
    drift |= row(metrics.crossings(rolled, "rolling_brier", 1.15 * F.col("baseline"), ["instrument"]).agg(F.coalesce(F.sum("crossings"), F.lit(0)).alias("crossings")))
    drift |= row(tables["drift"].agg(F.coalesce(F.sum(F.when(F.col("reason") == "drift", F.col("n_actions"))), F.lit(0)).alias("tree_drifts"), F.coalesce(F.sum(F.when(F.col("reason") == "warning", F.col("n_actions"))), F.lit(0)).alias("tree_warnings")))
    return shortened({"calibration": calibration, "trading": trading, "controller": last, "drift": drift})


def shortened(x):
    """Numbers to 12 digits: the order in which tasks' sums meet shows in the last ones, and a rebuilt report is to be the same."""
    if isinstance(x, dict):
        return {k: shortened(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return type(x)(shortened(v) for v in x)
    return float(f"{x:.12g}") if isinstance(x, float) else x


def overfit(fills: DataFrame, by: str, period_ns: int, n_chunks: int = 16) -> dict:
    """Probability that the best of several runs (column `by`, numbered from 0) is overfit, from their pnl by period."""
    at = fills.agg(F.min("exit_ts").alias("first"), F.max("exit_ts").alias("last")).first()
    if at.first is None or (at.last - at.first) // period_ns + 1 < n_chunks:
        return {}
    each = fills.groupBy(F.col(by).alias("strategy"), F.floor((F.col("exit_ts") - at.first) / period_ns).alias("period")).agg(F.sum("pnl").alias("r"))
    return stats.pbo(stats.cscv_pbo(each, n_chunks, periods=(at.last - at.first) // period_ns + 1)).first().asDict()


def cross_validate(spark: SparkSession, spec: ExperimentSpec, rows: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """Combinatorial purged folds: per-fold metrics and their summary.

    A fold is a run from its first to its last test row, or (cv.between false) one of each of its test blocks, so that
    nothing is traded outside of them. A run up to an earlier row is the beginning of a longer one from the same row:
    so runs are made once for each start, side by side, and folds take their part of the fills.
    """
    df, names = prepare(spark, spec, rows)
    numbered = df.withColumn("__row", F.row_number().over(features.by_time()) - 1)
    n = numbered.agg(F.max("__row")).first()[0]
    fills = fold_fills(spark, numbered, 0 if n is None else n + 1, spec.cv, spec.sim(names))
    each = metrics.trading(fills, spec.data.m_minutes, ["split"])
    return each, search.fold_summary(each).first().asDict()


def fold_fills(spark: SparkSession, numbered: DataFrame, n: int, cv: CvConfig, cfg: simulate.SimConfig) -> DataFrame:
    """Fills of each fold (split) over bars that have their number in their instrument's run as __row, below n."""
    folds = search.purged_folds(spark, n, cv.n_folds, cv.n_test, cv.purge, cv.embargo).where("kind = 'test' AND first < behind")
    pieces = folds.groupBy("split").agg(F.min("first").alias("__start"), F.max("behind").alias("behind")) if cv.between else folds.selectExpr("split", "first AS __start", "behind")
    runs = pieces.groupBy("__start").agg(F.max("behind").alias("behind"))
    # runs begin and end at a few rows, by which rows and runs are cut into the same blocks
    edges = F.array(*(F.lit(int(x)) for x in sorted({x for r in pieces.collect() for x in (r["__start"], r.behind)} or {0})))
    block = lambda x: F.size(F.filter(edges, lambda e: e <= x))
    blocks = runs.select("__start", F.explode(F.sequence(block(F.col("__start")), block(F.col("behind") - 1))).alias("__block"))
    near = numbered.withColumn("__block", block(F.col("__row"))).join(F.broadcast(blocks), "__block").drop("__block")  # at most n_folds ** 2 blocks

    done = simulate.replay(near, cfg, ("__start", "instrument")).where("kind = 'fill'")
    fills = done.selectExpr("__start", "instrument", "position_id AS idx", "entry_ts", "exit_ts", "reason", "pnl_net AS pnl")
    ends = numbered.where(F.exists(edges, lambda e: e == F.col("__row"))).select(F.col("instrument").alias("__of"), F.col("__row").alias("__end"), (F.col("open_time") * 1_000_000).alias("__until"))
    cut = fills.join(F.broadcast(pieces), "__start").join(ends, F.col("instrument").eqNullSafe(F.col("__of")) & (F.col("behind") == F.col("__end")), "left")
    return cut.where("__until IS NULL OR exit_ts < __until").select("split", "idx", "entry_ts", "exit_ts", "reason", "pnl")


def two_pass(spark: SparkSession, spec: ExperimentSpec, rows: DataFrame | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """A first pass that only watches, calibration of each instrument from it, and the run with the adaptive controller.

    Returns the calibration (instrument, n_used, sigma_max, r_star, tau) and the run's tables. Sigma is the
    spread of the offline ensemble; without one it is 0, and the gate by it stays open.
    """
    watch = spec.model_copy(update={"strategy": spec.strategy.model_copy(update={"kind": "threshold_gate", "tau": 2.0})})
    seen = backtest(spark, watch, rows)["trace"].withColumn("sigma", F.coalesce("sigma_ve", F.lit(0.0)))
    found = controller.calibrate(seen)
    finite = F.when(F.col("sigma_max") < float("inf"), F.col("sigma_max"))
    own = found.select("instrument", F.col("tau").alias("tau0"), F.col("r_star").alias("r0"), finite.alias("sigma_max"))
    main = spec.model_copy(update={"strategy": spec.strategy.model_copy(update={"kind": "composite_adaptive"})})
    return found, backtest(spark, main, rows, own)


def run(spark: SparkSession, spec: ExperimentSpec, out: str | None = None, rows: DataFrame | None = None) -> dict:
    """Run a spec, by its mode; with `out` write tables and report there. Returns the metrics."""
    if spec.mode == "cv":
        each, summary = cross_validate(spark, spec, rows)
        result: dict = {"cv": summary, "trading": {"n_trades": summary["n_trades"] or 0, "sharpe": summary["mean_sharpe"]}}
        tables = {"folds": each}
    else:
        tables = backtest(spark, spec, rows)
        result = battery(tables, spec.data.m_minutes)
    result["rejected_by"] = search.failed_gates(result["trading"], spec.accept.min_trades, spec.accept.sharpe_floor, spec.accept.max_seed_gap)
    if out:
        report(result, tables, spec, out)
    return result


def report(result: dict, tables: dict[str, DataFrame], spec: ExperimentSpec, out: str) -> None:
    """A table for each output, a JSON file for each section, and a manifest of both."""
    if "outputs" in tables:
        tables["outputs"].write.mode("overwrite").partitionBy("kind").parquet(f"{out}/outputs")
        hashes = {"outputs": table_hash(tables["outputs"])}
    else:
        tables["folds"].write.mode("overwrite").parquet(f"{out}/folds")
        hashes = {"folds": table_hash(tables["folds"])}
    _sections(result, spec, out, hashes)


def _sections(result: dict, spec: ExperimentSpec, out: str, hashes: dict[str, str]) -> None:
    known = {"overview": {"name": spec.name, "digest": spec.digest(), "rejected_by": result["rejected_by"]}, "spec": spec.model_dump(mode="json")}
    sections = {}
    for order, name in enumerate(SECTIONS):
        block = known.get(name, result.get(name))
        if block is not None:
            minutes.write_json(block, f"{out}/{name}.json")
            sections[name] = {"order": order, "file": f"{name}.json"}
    minutes.write_json(result, f"{out}/metrics.json")
    minutes.write_json({"schema_version": 1, "generated_at": datetime.datetime.now(datetime.UTC).isoformat(), "sections": sections, "hashes": hashes}, f"{out}/manifest.json")
    for stale in set(files.names(out, ".json")) - {s["file"] for s in sections.values()} - {"metrics.json", "manifest.json"}:
        files.delete(f"{out}/{stale}")


def read_report(out: str) -> dict:
    return json.loads(files.read(f"{out}/manifest.json")) | {"metrics": json.loads(files.read(f"{out}/metrics.json"))}


def reports(folder: str) -> list[dict]:
    """Of each report in the folders of `folder`: its folder, name, number of trades, Sharpe ratio and reasons against it."""
    out = []
    for name in files.folders(folder):
        try:
            shown = read_report(f"{folder}/{name}")
        except FileNotFoundError:
            continue
        trading = shown["metrics"].get("trading", {})
        overview = json.loads(files.read(f"{folder}/{name}/overview.json"))
        out.append({"folder": name, "name": overview.get("name"), "n_trades": trading.get("n_trades"), "sharpe": trading.get("sharpe"), "rejected_by": overview.get("rejected_by")})
    return out


def rebuild(spark: SparkSession, out: str) -> dict:
    """The metrics and sections of a report once more, from its tables and its spec."""
    spec = ExperimentSpec.model_validate(json.loads(files.read(f"{out}/spec.json")))
    outputs = spark.read.parquet(f"{out}/outputs")
    result = battery(named(outputs), spec.data.m_minutes)
    result["rejected_by"] = search.failed_gates(result["trading"], spec.accept.min_trades, spec.accept.sharpe_floor, spec.accept.max_seed_gap)
    _sections(result, spec, out, {"outputs": table_hash(outputs)})
    return result
