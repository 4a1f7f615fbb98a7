"""The offline model: gradient-boosted symmetric trees over several seeds, frozen and scored as one ensemble."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelorus.operators import boosting
from pelorus.operators.boosting import Params, Tree


@dataclasses.dataclass
class Member:
    """One seed's model: columns, their borders, the first score, trees."""

    names: list[str]
    borders: list[list[float]]
    base: float
    trees: list[Tree]


def fit(train: DataFrame, names: Sequence[str], seeds: Sequence[int] = (42, 43, 44), weight: str | None = None, validation: str | None = None, params: Params = Params(), rows: int | None = None) -> list[Member]:
    """One model for each seed, on rows with a label. validation: a boolean column of rows to stop early by, which then aren't learned from.

    Nulls and NaN are a bin of their own, below all values. Rows beyond `rows` (boosting.ROWS) are fitted in blocks.
    """
    cuts, base, trees = boosting.fit(train, names, seeds, weight, validation, params, rows)
    return [Member(list(names), cuts, base, trees[s]) for s in seeds]


def score(df: DataFrame, models: Sequence[Member]) -> DataFrame:
    """p_offline: mean over the members; sigma_ve: their population standard deviation, 0 for one member."""
    names = sorted({n for m in models for n in m.names})
    at = {n: i for i, n in enumerate(names)}
    sent = df.sparkSession.sparkContext.broadcast(list(models))  # a model's size follows from its parameters
    out = T.StructType([*df.schema.fields, T.StructField("p_offline", T.DoubleType()), T.StructField("sigma_ve", T.DoubleType())])
    inputs = df.withColumn("__x", F.array(*(F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double")) for n in names)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = part.column(part.num_columns - 1)
            values = x.values.to_numpy(zero_copy_only=False).astype(float)[x.offset * len(names) : (x.offset + len(x)) * len(names)].reshape(-1, len(names)).T
            ps = np.array([boosting.sigmoid(boosting.margins([values[at[n]] for n in m.names], m.borders, m.base, m.trees)) for m in sent.value]).reshape(len(sent.value), -1)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ps.mean(axis=0)), pa.array(ps.std(axis=0))], [f.name for f in out.fields])

    return inputs.mapInArrow(run, out)


def save(models: Sequence[Member], path: str) -> None:
    """A file of JSON for each member, through Spark's file systems."""
    spark = SparkSession.active()
    rows = [(i, json.dumps(dataclasses.asdict(m))) for i, m in enumerate(models)]
    for i, text in rows:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/member{i}")


def load(spark: SparkSession, path: str, n: int) -> list[Member]:
    out = []
    for i in range(n):
        got = json.loads(spark.read.text(f"{path}/member{i}").first().value)
        out.append(Member(got["names"], got["borders"], got["base"], [Tree(**t) for t in got["trees"]]))
    return out


def evaluate(df: DataFrame, label: str = "label", p: str = "p_offline") -> DataFrame:
    """Log loss, Brier, base rate and the range of p of labelled rows."""
    from pelorus.functions import metrics

    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), F.col(p).alias("p"))
    return rows.agg(F.count("*").alias("n"), metrics.log_loss().alias("log_loss"), metrics.brier().alias("brier"), F.avg("y").alias("base_rate"), F.min("p").alias("p_min"), F.max("p").alias("p_max"), F.avg("p").alias("p_mean"), F.stddev_pop("p").alias("p_std"))
