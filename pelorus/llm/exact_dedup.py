"""Exact dedup with a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.llm.common import SPACES, Scratch, least_rows, salt, table, texts, totals, whole_rows

#: Copies of a row that are made by one array.
COPIES = 10_000


def digest(text: Column) -> Column:
    """SHA-256 of the text without ASCII white space, 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(text, SPACES + "+", "").cast("binary"), 256))


class DigestIndex:
    """One row for each text seen so far: digest, doc_id and n_chars of the row that stayed, and the batch it came with.

    The files at `path` are a Parquet table clustered and sorted by digest, so batches join it
    without shuffling or sorting it. A later session opens the same path again; the number of buckets
    is kept there, in a file that Spark's readers leave out, and holds whatever the session's settings
    are. Opening it with another number is an error.
    """

    ABOUT = "_pelorus_index.json"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.name = spark, path, f"pelorus_digests_{uuid.uuid4().hex}"
        kept = self._about()
        if kept and buckets and buckets != kept:
            raise ValueError(f"the index at {path} has {kept} buckets, not {buckets}")
        self.buckets = kept or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not kept:
            self._write_about()
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, doc_id BIGINT, n_chars BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def _file(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.ABOUT}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _about(self) -> int | None:
        at, files = self._file()
        if files.exists(at):
            stream = files.open(at)
            try:
                return int(json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["buckets"])
            finally:
                stream.close()
        if files.exists(at.getParent()) and any(f.getPath().getName().startswith("part-") for f in files.listStatus(at.getParent())):
            raise ValueError(f"{self.path} has files, but nothing says how many buckets they are in")
        return None

    def _write_about(self) -> None:
        at, files = self._file()
        stream = files.create(at, False)
        try:
            stream.write(json.dumps({"buckets": self.buckets}).encode())
        finally:
            stream.close()

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame, batch: str) -> None:
        """Add rows (digest, doc_id, n_chars) under a batch's name, but for those that an earlier try of it has added."""
        had = self.rows().where(F.col("batch") == batch).select("digest")
        new = rows.select("digest", "doc_id", "n_chars").join(had.hint("merge"), "digest", "left_anti")
        new.withColumn("batch", F.lit(batch)).repartition(self.buckets, "digest").write.insertInto(self.name)

    def close(self) -> None:
        """Forget the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def exact_dedup(docs: DataFrame, index: DigestIndex, scratch: Scratch, batch: str | None = None) -> DataFrame:
    """Decide which rows of docs (doc_id, text) are new, and append those to the index.

    Texts are equal when identical without `[\\x20\\x09-\\x0D]`; null counts as empty. Of equal texts
    in docs the longest original, then the smallest doc_id stays (a null doc_id loses a tie), unless
    the index knows the text already: then all rows go and keep_id names the index's row. Of rows
    that repeat with the same doc_id and text one stays. An empty table gives an empty result.

    `batch` names docs in the index. What the index has under that name counts as new: a batch that
    is run again, after a crash before its result was written, decides as it did the first time.
    Without a name each call is a batch of its own.

    Returns a row per row of docs: doc_id, n_chars, digest, keep_id, group_size (rows of docs with that
    text), kept, repeated (whether it is kept and other rows are alike in the first three).
    """
    batch = batch or uuid.uuid4().hex
    rows = (
        texts(docs)
        .select("doc_id", F.length("text").cast("long").alias("n_chars"), digest(F.col("text")).alias("digest"), F.spark_partition_id().alias("part"))
        .groupBy("doc_id", "n_chars", "digest", "part")
        .agg(F.count("*").alias("here"))
        .withColumn("salt", salt("doc_id", "n_chars", "part"))
    )
    rows = scratch.settle(rows, "rows")
    low, high = F.bitwise_not("doc_id").alias("not_id"), F.bitwise_not("part").alias("not_part")
    best, last = F.struct("n_chars", low, high, "here"), F.struct("n_chars", low, "part")
    groups = totals(rows, "digest", "doc_id", ("group_size", F.sum("here"), F.sum("group_size")), ("best", F.max(best), F.max("best")), ("last", F.max(last), F.max("last")))
    groups = groups.select(
        "digest", "salt", "group_size", F.col("best.n_chars").alias("keep_chars"), F.bitwise_not("best.not_id").alias("keep_id"), F.bitwise_not("best.not_part").alias("keep_part"),
        ((F.col("best.here") > 1) | (F.bitwise_not("best.not_part") != F.col("last.part"))).alias("repeated"),
    )
    groups = scratch.settle(groups, "groups")
    one = groups.groupBy("digest").agg(F.first("keep_id").alias("doc_id"), F.first("keep_chars").alias("n_chars"))
    before = index.rows().where(F.col("batch") != batch)
    fresh = scratch.settle(one.join(before.hint("merge"), "digest", "left_anti"), "fresh")
    index.append(fresh, batch)
    known = index.rows().select("digest", F.col("doc_id").alias("known_id"))
    state = groups.join(known.hint("merge"), "digest").join(fresh.select("digest", F.lit(True).alias("fresh")).hint("merge"), "digest", "left")
    state = state.select("digest", "salt", "group_size", "known_id", "keep_id", "keep_chars", "keep_part", "repeated", F.coalesce("fresh", F.lit(False)).alias("fresh"))
    state = scratch.settle(state, "state")
    stays = F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    out = rows.join(state.hint("merge"), ["digest", "salt"]).withColumn("stays", stays)
    # a row for each copy, by arrays of at most COPIES
    out = out.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("here") - 1) / COPIES)))).withColumn("left", F.least(F.lit(COPIES), F.col("here") - F.col("block") * COPIES).cast("int"))
    out = out.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("left"))))
    only = F.col("stays") & (F.col("part") == F.col("keep_part")) & (F.col("block") == 0) & (F.col("nth") == 1)
    return out.select("doc_id", "n_chars", "digest", F.col("known_id").alias("keep_id"), "group_size", only.alias("kept"), (only & F.col("repeated")).alias("repeated"))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Whole rows of docs that exact_dedup kept; of rows that repeat, the least of them as JSON."""
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    keyed = whole_rows(docs).withColumns({"id": F.col("row.doc_id").cast("long"), "n": F.length(text).cast("long"), "d": digest(text)})
    own = kept.where("kept").select(F.col("doc_id").alias("k_id"), F.col("n_chars").alias("k_n"), F.col("digest").alias("k_d"), "repeated")
    on = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("n") == F.col("k_n")) & (F.col("d") == F.col("k_d"))
    single = keyed.join(own.where("NOT repeated").drop("repeated"), on, "left_semi").select("row.*")
    repeated = own.where("repeated").drop("repeated")
    if repeated.isEmpty():
        return single
    return single.union(least_rows(keyed.join(repeated, on, "left_semi"), ["id", "n", "d"]).select("row.*"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op4")
    index = DigestIndex(spark, f"{scratch.root}/index")
    out = exact_dedup(table(spark, sf_dir, "documents"), index, scratch)
    index.close()
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER g AS keep_id, row_number() OVER g AS nth,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM w
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup as a pipeline stage: of each text (see exact_dedup) the row that stays, with all columns of docs.

    A null text is like an empty one, and one row of those stays; a null doc_id loses a tie; rows that
    repeat leave one; an empty table gives an empty one. Columns can have any names and types.
    """
    scratch = Scratch(spark, "stage-exact")
    index = DigestIndex(spark, f"{scratch.root}/index")
    decided = exact_dedup(docs, index, scratch)
    kept = scratch.settle(decided.where("kept"), "kept")
    index.close()
    return keep_rows(docs, kept)
