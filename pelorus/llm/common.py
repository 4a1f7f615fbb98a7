"""Shared plumbing: cleaned inputs, scratch tables in the shared folder, group attachment, components."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word and normalisation rules of the operators use it.
SPACES = r"[\x20\x09-\x0D]"
#: Salts over which the rows of one key are spread before their partial results meet: as many, or a quarter of the shuffle partitions.
SALTS = 64
#: Shuffle files of a finished write are of no more use; this setting has Spark remove them at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns can't clash; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def whole_rows(df: DataFrame) -> DataFrame:
    """One column `row`, a struct of all columns of df, beside which helper columns can have any name."""
    return df.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns)).alias("row"))


def least_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of `row` (see whole_rows) one for each value of the keys: the least as JSON, which columns of any type have."""
    return rows.groupBy(*keys).agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")


def salt(*cols: str | Column) -> Column:
    parts = int(SparkSession.active().conf.get("spark.sql.shuffle.partitions"))
    return F.pmod(F.xxhash64(*cols), F.lit(max(SALTS, parts // 4))).cast("int")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one of our own only in local mode where none is set."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if own := spark.sparkContext.getCheckpointDir():
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="pelorus-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{path}")
    return f"file://{path}"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Scratch:
    """Tables of one operator run, written as Parquet to the shared folder, where a lost executor can't take them along."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/pelorus/{name}-{uuid.uuid4().hex}"
        atexit.register(self._clean)

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it again: a plan that starts at the files, without the lineage before them."""
        with shuffles_removed(self.spark):
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def bucketed(self, df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
        """Like settle, with rows dealt to `buckets` files by a hash of column: groups by that column need no shuffle."""
        known = f"pelorus_{uuid.uuid4().hex}"
        with shuffles_removed(self.spark):
            df.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column).option("path", f"{self.root}/{name}").saveAsTable(known)
        made = self.spark.table(known)
        self.spark.sql(f"DROP TABLE {known}")  # the name; the frame is resolved and the files stay
        return made

    def _clean(self) -> None:
        """At the driver's end, if its session still runs: results have been read by then."""
        if self.spark.sparkContext._jsc is not None and self.spark.sparkContext._jsc.sc().isStopped() is False:
            self.drop("")

    def drop(self, *names: str) -> None:
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(hadoop).delete(path, True)


def totals(rows: DataFrame, key: str, by: str | Column, *aggs: tuple[str, Column, Column]) -> DataFrame:
    """Aggregates of each key, one row per key and salt that occurs.

    aggs: (name, aggregate of rows, aggregate of those partial results). Rows of a key meet by salt
    first, so no task gets all rows of a hot key, and `rows` joins the result on key and salt
    with a hot key's rows spread over as many tasks as there are salts. Rows need a column `salt` = salt(by).
    """
    part = rows.groupBy(key, "salt").agg(*(first.alias(name) for name, first, _ in aggs))
    whole = part.groupBy(key).agg(*(then.alias(name) for name, _, then in aggs), F.collect_list("salt").alias("salts"))
    return whole.withColumn("salt", F.explode("salts")).drop("salts")


def components(edges: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """Connected components of edges (a long, b long): node, root (least node of its component).

    Alternating large-star and small-star rounds (Kiveris et al., 2014) until nothing changes. Each
    round is written to the shared folder; a node's links are spread over salts, so one with very many is no burden.
    Nodes without an edge aren't in the result.
    """
    spark = edges.sparkSession
    state = scratch.settle(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}0"
    )
    mark = -1
    for i in range(1, 200):
        # large star: all larger neighbours of a node (and itself) link to the least of its neighbourhood
        both = state.union(state.select("v", "u")).withColumn("salt", salt("v"))
        least = totals(both, "u", "v", ("m", F.min("v"), F.min("m"))).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours link to the least of them
        large = large.withColumn("salt", salt("v"))
        joined = large.join(totals(large, "u", "v", ("m", F.min("v"), F.min("m"))), ["u", "salt"])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        state = scratch.settle(small.where("u <> v").distinct(), f"{name}{i}")
        scratch.drop(f"{name}{i - 1}")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components: no fixed point after 200 rounds")
    return state.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
