"""The corpus pipeline: language ID, exact dedup, near-dedup, secret scan, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pelorus.llm import exact_dedup, language_id, packing, secret_scan, simhash_similar
from pelorus.llm.common import Scratch

STAGES = [
    ("language_id", language_id.stage),
    ("exact_dedup", exact_dedup.stage),
    ("simhash_near_dedup", simhash_similar.stage),
    ("secret_scan", secret_scan.stage),
    ("packing", packing.stage),
]

#: Language ID and the secret scan learn a model and can't be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each writes its result, which the next one reads.

    A null text counts as empty: the language stage drops it, as all texts without letters. Of rows that
    repeat, and of equal or near equal texts, one stays; of ties the smallest doc_id, a null one last.
    An empty table gives no rows. Further columns go along up to packing, whatever their names.
    """
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.settle(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
