"""Sealed pipelines of transforms, the registry of stages, and hashes of tables."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelorus.operators import features, labels

Transform = Callable[[DataFrame], DataFrame]
#: Kinds in the order in which stages may stand.
KINDS = ("SOURCE", "AGGREGATOR", "FEATURE", "REGIME", "MODEL", "LABEL", "CALIBRATOR", "STRATEGY")


@dataclasses.dataclass(frozen=True)
class Stage:
    name: str
    kind: str
    apply: Transform


class StageError(RuntimeError):
    """A stage failed: its name, what was done, and why."""

    def __init__(self, stage: str, op: str, cause: BaseException):
        super().__init__(f"{stage}: {op} failed: {cause}")
        self.stage, self.op, self.cause = stage, op, cause


class Pipeline:
    """Stages of rising kinds with unique names, the last one a strategy."""

    def __init__(self, stages: Iterable[Stage]):
        self.stages = tuple(stages)
        if not self.stages:
            raise ValueError("a pipeline has a stage")
        if bad := [s.name for s in self.stages if s.kind not in KINDS]:
            raise ValueError(f"unknown kinds: {bad}")
        order = [KINDS.index(s.kind) for s in self.stages]
        if order != sorted(order):
            raise ValueError("kinds must not fall")
        if len({s.name for s in self.stages}) < len(self.stages):
            raise ValueError("names must differ")
        if self.stages[-1].kind != "STRATEGY":
            raise ValueError("the last stage is a strategy")

    def __call__(self, df: DataFrame) -> DataFrame:
        def one(df: DataFrame, stage: Stage) -> DataFrame:
            try:
                return df.transform(stage.apply)
            except Exception as e:
                raise StageError(stage.name, "transform", e) from e

        return functools.reduce(one, self.stages, df)


_STAGES: dict[str, tuple[Callable[..., Transform], str]] = {}


def register_stage(name: str, make: Callable[..., Transform], kind: str, overwrite: bool = False) -> None:
    if name in _STAGES and not overwrite:
        raise ValueError(f"{name} is registered")
    _STAGES[name] = (make, kind)


def make_stage(name: str, **params) -> Stage:
    make, kind = _STAGES[name]
    return Stage(name, kind, make(**params))


def registered() -> dict[str, str]:
    return {n: k for n, (_, k) in _STAGES.items()}


register_stage("base_features", lambda: features.base_features, "FEATURE")
register_stage("rolling_features", lambda specs: lambda df: features.build(df, specs), "FEATURE")
register_stage("labels", lambda **kw: lambda df: labels.labels(df, **kw), "LABEL")


def table_hash(df: DataFrame) -> str:
    """A hash of a table's rows in any order."""
    total = df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.count("*")).first()
    return f"{(int(total[0] or 0)) % (1 << 64):016x}-{total[1]}"
