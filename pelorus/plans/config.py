"""Experiment specifications: validated models, read from YAML or JSON."""

from __future__ import annotations

import hashlib
import json
from typing import Literal

import yaml
from pydantic import BaseModel, ConfigDict, Field

from pelorus.operators.broker import Costs
from pelorus.operators.simulate import SimConfig
from pelorus.sources import files

#: Keys of earlier versions that are passed over.
LEGACY = {"aci": None, "strategy": ("alpha", "layer"), "training": ("warm_start", "warm_samples")}


class Model(BaseModel):
    model_config = ConfigDict(extra="forbid", frozen=True)


class DataConfig(Model):
    path: str
    m_minutes: int = Field(20, ge=1)
    start_ms: int | None = None
    end_ms: int | None = None
    bars: Literal["count", "time"] = "count"


class StrategyConfig(Model):
    kind: Literal["threshold_gate", "pure_conformal", "ev_calibrated_size", "composite_adaptive", "regime_gated"] = "threshold_gate"
    tau: float = 0.5
    extra: dict = Field(default_factory=dict)


class BrokerConfig(Model):
    tp: float = 0.0041
    sl: float = float("inf")
    latency: int = Field(1, ge=0)
    inventory_cap: int = Field(1, ge=1)
    tie: Literal["pessimistic", "optimistic", "bernoulli"] = "pessimistic"
    taker_bps: float = 1.0
    spread_bps: float = 0.0
    slippage_bps: float = 0.0


class ModelConfig(Model):
    alpha_label: float = 0.0041113
    learn: bool = True
    #: How many features of the catalog are learned from, None for all; in the order of importance, if a file gives it.
    n_features: int | None = Field(8, ge=1)
    importance_path: str | None = None
    offline_path: str | None = None
    offline_members: int = 1
    warmup: int = 0
    seed: int = 42


class CVConfig(Model):
    n_folds: int = 10
    n_test: int = 2
    purge: int = 1
    embargo: int = 5
    between: bool = True  # a fold is one run from its first to its last test row, with what lies between its test blocks


class GateConfig(Model):
    min_trades: int | None = None
    sharpe_floor: float | None = None
    max_seed_gap: float | None = None


class ExperimentSpec(Model):
    """name, mode and the configuration block."""

    name: str = "experiment"
    mode: Literal["backtest", "cv"] = "backtest"
    data: DataConfig
    model: ModelConfig = ModelConfig()
    strategy: StrategyConfig = StrategyConfig()
    broker: BrokerConfig = BrokerConfig()
    cv: CVConfig = CVConfig()
    accept: GateConfig = GateConfig()

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.model_dump(mode="json"), sort_keys=True).encode()).hexdigest()[:16]

    def sim(self, features: tuple[str, ...] = ()) -> SimConfig:
        params = {**self.strategy.extra}
        if self.strategy.kind in ("threshold_gate", "pure_conformal", "ev_calibrated_size"):
            params["tau"] = self.strategy.tau
        elif self.strategy.kind == "composite_adaptive":
            params.setdefault("tau0", self.strategy.tau)
        b = self.broker
        return SimConfig(
            m_minutes=self.data.m_minutes, warmup=self.model.warmup, alpha_label=self.model.alpha_label, tp=b.tp, sl=b.sl, latency=b.latency, inventory_cap=b.inventory_cap, tie=b.tie,
            costs=Costs(b.taker_bps, b.spread_bps, b.slippage_bps), strategy=self.strategy.kind, params=tuple(sorted(params.items())), features=features, learn=self.model.learn, seed=self.model.seed,
        )


def load(path: str) -> ExperimentSpec:
    """A spec from a YAML (or JSON) file; keys of earlier versions are left out, unknown ones are an error."""
    raw = yaml.safe_load(files.read(path)) or {}
    for block, keys in LEGACY.items():
        if keys is None:
            raw.pop(block, None)
        elif isinstance(raw.get(block), dict):
            raw[block] = {k: v for k, v in raw[block].items() if k not in keys}
    if raw.get("training") == {}:
        raw.pop("training")
    return ExperimentSpec.model_validate(raw)
