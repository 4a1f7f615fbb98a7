"""Document fingerprints: bottom-k sketches of word shingles, as column expressions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelorus.llm.common import SPACES, Scratch, table

SHINGLE = 5
K = 128
#: Text of the rows that one window partition sorts, in the mean.
RANGE_BYTES = 2_000_000
#: Ranges whose bounds (8 bytes each) are broadcast; with more they are joined by a shuffle.
BROADCAST_RANGES = 1_000_000
LEAST_ID = -(1 << 63)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The k least distinct hashes of a text's word shingles, ascending.

    Fewer words than a shingle make one shingle; a text without words has an empty sketch.
    """
    words = F.filter(F.split(text, SPACES + "+"), lambda w: w != "")

    def hashes(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, shingle)))
        return F.when(F.size(w) > 0, F.slice(F.sort_array(F.array_distinct(each)), 1, k)).otherwise(F.array().cast("array<bigint>"))

    return let(words, hashes)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(column: Column, k: int = K) -> Column:
    """Aggregate: the sketch of a group's shingles together."""
    return F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(column)))), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the Jaccard similarity; two empty sketches are alike."""

    def share(both: Column) -> Column:
        common = F.filter(F.array_intersect(a, b), lambda h: h <= F.element_at(both, -1))
        return F.when(F.size(both) == 0, 1.0).otherwise(F.size(common) / F.size(both))

    return let(merge(a, b, k), share).cast("double")


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles; exact below k."""
    part = (F.element_at(a, -1) / F.lit(2.0**64)) + F.lit(0.5)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / part)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's shingles that b has."""
    j = resemblance(a, b, k)
    both = j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as a string: 16 lowercase hexadecimal digits for each hash."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def _below(bounds: Column, value: Column) -> Column:
    """How many of the bounds are below value."""
    return F.size(F.filter(bounds, lambda b: b < value))


def _place(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are below value, by a search in two levels."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    lasts = F.array(*(F.lit(r[-1]) for r in rows))
    table_ = F.array(*(F.array(*map(F.lit, r)) for r in rows))
    return let(_below(lasts, value), lambda n: n * step + F.when(n < len(rows), _below(F.get(table_, n), value)).otherwise(0)).cast("int")


def ranges(keys: DataFrame, scratch: Scratch) -> tuple[DataFrame, Column] | None:
    """Ranges of keys (key, not_tie, bytes) of about RANGE_BYTES each: place, single, tops, next_place; and the place of a key. None for no keys.

    The keys' quantiles cut them into places, as many as the root of the number of ranges; those cut
    each place into ranges by its own quantiles: of key, or of not_tie in a place that is a single key. tops has
    the greatest value of each range that occurs, ascending. Only the places' bounds come to the driver.
    """
    total = keys.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).first()
    if not total.n:
        return None
    parts = max(1, math.ceil((total.bytes or 0) / RANGE_BYTES))
    first = math.ceil(math.sqrt(parts))
    second = math.ceil(parts / first)
    bounds = sorted(set(keys.agg(F.percentile_approx("key", _shares(first), max(10_000, 10 * first))).first()[0])) if first > 1 else []
    place = _place(F.col("key"), bounds)
    placed = keys.select(place.alias("place"), "key", "not_tie")
    cut = lambda c: F.percentile_approx(c, _shares(second), max(10_000, 10 * second)) if second > 1 else F.first(F.array().cast("array<bigint>"))
    by_place = placed.groupBy("place").agg((F.min("key") == F.max("key")).alias("single"), cut("key").alias("keys"), cut("not_tie").alias("ties"))
    by_place = by_place.select("place", "single", F.when(F.col("single"), F.col("ties")).otherwise(F.col("keys")).alias("cuts"))
    value = F.when(F.col("single"), F.col("not_tie")).otherwise(F.col("key"))
    joined = placed.join(F.broadcast(by_place) if parts <= BROADCAST_RANGES else by_place, "place").select("place", "single", value.alias("value"), "cuts")
    tops = joined.groupBy("place", "single", _below(F.col("cuts"), F.col("value")).alias("nth")).agg(F.max("value").alias("top"))
    made = scratch.settle(tops.groupBy("place", "single").agg(F.sort_array(F.collect_list("top")).alias("tops")), "ranges")
    order = Window.orderBy("place")  # of a row for each place
    after = F.coalesce(F.lead("place").over(order), F.first("place").over(order)).alias("next_place")
    made = made.select("place", "single", "tops", after)
    return F.broadcast(made) if parts <= BROADCAST_RANGES else made, place


def with_next(rows: DataFrame, order: str, size: str, columns: list[str], scratch: Scratch) -> DataFrame:
    """Add next_<column>: the value in the next row by descending `order` (null last; ties by the row's `tie`); after the last row the first.

    Rows are dealt to `ranges` of `order`. A range ends at a value that occurs, and the rows with that
    value are also sent to the range above, behind its rows, so every row finds its successor in its
    own range. Rows of one `order` are cut into ranges by `tie`; only those alike in both stay together.
    """
    key, not_tie = F.coalesce(F.col(order), F.lit(LEAST_ID)), F.bitwise_not("tie")
    keys = scratch.settle(rows.select(key.alias("key"), not_tie.alias("not_tie"), F.col(size).alias("bytes")), "keys")
    made = ranges(keys, scratch)
    if made is None:
        return rows.limit(0).withColumns({f"next_{c}": F.col(c) for c in columns})
    dealt = rows.withColumns({"key": key, "not_tie": not_tie}).withColumn("place", made[1]).join(made[0], "place")
    dealt = dealt.withColumn("value", F.when(F.col("single"), F.col("not_tie")).otherwise(F.col("key"))).withColumn("nth", _below(F.col("tops"), F.col("value")))
    last = F.col("nth") == F.size("tops") - 1
    own = F.struct("place", "nth", F.lit(False).alias("extra"))
    above = F.struct(F.when(last, F.col("next_place")).otherwise(F.col("place")).alias("place"), F.when(last, 0).otherwise(F.col("nth") + 1).alias("nth"), F.lit(True).alias("extra"))
    dealt = dealt.withColumn("to", F.explode(F.when(F.get("tops", F.col("nth")) == F.col("value"), F.array(own, above)).otherwise(F.array(own))))
    window = Window.partitionBy("to.place", "to.nth").orderBy("to.extra", F.desc("key"), F.desc("not_tie"))
    out = dealt.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns}).where("NOT to.extra")
    return out.drop("key", "not_tie", "place", "single", "tops", "next_place", "value", "nth", "to")


def _shares(parts: int) -> list[float]:
    return [i / parts for i in range(1, parts)]


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of whole texts and of edited ones, and their likeness.

    A null text is empty; an empty sketch is the empty string. Repeated rows have each their row, and
    rows with one doc_id follow each other by a hash of their texts; a null doc_id comes last. An empty
    table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = docs.withColumns({"bytes": F.octet_length("text"), "tie": F.xxhash64("text"), "sketch": sketch(F.col("text"))})
    rows = with_next(rows, "doc_id", "bytes", ["text", "sketch"], Scratch(spark, "op2"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
