"""SimHash near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.llm import spans
from pelorus.llm.common import Scratch, components, least_rows, salt, table, totals, whole_rows

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Buckets are 2**LEAST_BITS or more, so that all tasks have some; and as many copies of a fingerprint are dealt out in one pass.
LEAST_BITS = 7
#: Fingerprints that one bucket holds in the mean, and variants that its task makes at a time.
BUCKET_FINGERPRINTS = 1 << 20
SLICE_VARIANTS = 1 << 22


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text: bit i is 1 if it is set in over half the shingles' hashes."""
    words = text.encode().lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    values = np.array([h(joined[a:b], SEED) for a, b in zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist())], np.uint64)
    count = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):
        part = values[at : at + (1 << 16)]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(values), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns (long) and fp, the fingerprint as a signed long; a null text counts as empty."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in spans.few(parts):
            fp = np.array([simhash(t, shingle) for t in part.column(len(keys)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(fp)], [*keys, "fp"])

    rows = docs.select(*(F.col(k).cast("long").alias(k) for k in keys), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", fp long")


@functools.cache
def flips(radius: int) -> np.ndarray:
    """All masks of at most `radius` of 64 bits."""
    bit = [1 << i for i in range(64)]
    out, last = [0], [(0, -1)]
    for _ in range(radius):
        last = [(m | bit[j], j) for m, i in last for j in range(i + 1, 64)]
        out += [m for m, _ in last]
    return np.array(out, np.uint64)


def label(values: np.ndarray, bits: int) -> np.ndarray:
    """A linear hash: the label of a ^ b is the label of a ^ the label of b."""
    per_bit = spans.mix(np.arange(1, 65, dtype=np.uint64) * spans.BASE)
    out = np.zeros(len(values), np.uint64)
    for i in range(64):
        out ^= ((values >> np.uint64(i)) & np.uint64(1)) * per_bit[i]
    return (out & np.uint64((1 << bits) - 1)).astype(np.int64)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of every node to the least node of its component, for links a - b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def collide(fps: np.ndarray, bucket: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints (distinct) that share a variant whose label is `bucket`, as a forest.

    Fingerprints with a common variant differ in at most 2 * radius bits. Of those with one variant,
    each links to the least, so a group of m has m - 1 links, not all pairs.
    """
    masks = flips(radius)
    more = max(0, math.ceil(math.log2(max(1, len(fps) * len(masks) / (1 << bits) / SLICE_VARIANTS))))
    own, of_mask = label(fps, bits + more), label(masks, bits + more)
    order = np.argsort(own, kind="stable")
    fps, own = fps[order], own[order]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for slice_ in range(1 << more):
        want = (bucket | slice_ << bits) ^ of_mask
        parts = [fps[a:b] for a, b in zip(np.searchsorted(own, want).tolist(), np.searchsorted(own, want, "right").tolist())]
        source = np.concatenate(parts)
        variant = source ^ np.repeat(masks, [len(p) for p in parts])
        ranked = np.sort(variant)
        twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        if not len(twice):
            continue
        seen = np.zeros(1 << 20, bool)
        seen[(twice * spans.BASE) >> np.uint64(44)] = True
        near = seen[(variant * spans.BASE) >> np.uint64(44)]
        source, variant = source[near], variant[near]
        group = np.searchsorted(twice, variant)
        real = twice[np.minimum(group, len(twice) - 1)] == variant
        source, group = source[real], group[real]
        least = np.full(len(twice), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, group, source)
        to = least[group]
        good = (source != to) & (np.bitwise_count(source ^ to) <= 2 * radius)
        if good.any():
            found.append(forest(source[good], to[good]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))


def bucket_bits(n: int, radius: int) -> tuple[int, int]:
    """For n fingerprints the number of buckets and of passes over them, as powers of two.

    A fingerprint goes to each bucket that a variant of it falls in: to all at first, to as many as
    there are variants once buckets are far more than those. So buckets hold n times that share.
    """
    bits = LEAST_BITS
    while bits < 62 and n * (reach := len(np.unique(label(flips(radius), bits)))) > BUCKET_FINGERPRINTS << bits:
        bits += 1
    reach = len(np.unique(label(flips(radius), bits)))
    return bits, max(0, math.ceil(math.log2(reach)) - LEAST_BITS)


def deal(fps: np.ndarray, bits: int, passes: int, nth: int, radius: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The buckets, among those of the nth of 2**passes passes, that variants of fps fall in, and the fingerprints of each.

    A pass has the buckets whose last `passes` bits are its number. Labels are linear, so which of a
    fingerprint's variants those are follows from the last bits of its own label.
    """
    reach = np.unique(label(flips(radius), bits))
    own, last = label(fps, bits), (1 << passes) - 1
    buckets, source = [], []
    for low in range(1 << passes):
        at = np.flatnonzero((own & last) == low)
        there = reach[(reach & last) == low ^ nth]
        if len(at) and len(there):
            buckets.append((own[at][:, None] ^ there).reshape(-1))
            source.append(np.repeat(fps[at], len(there)))
    if not buckets:
        return np.zeros(0, np.int64), []
    bucket, fp = np.concatenate(buckets), np.concatenate(source)
    order = np.argsort(bucket, kind="stable")
    bucket, fp = bucket[order], fp[order]
    head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return bucket[head], np.split(fp, head[1:])


def near_links(fps: DataFrame, scratch: Scratch, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp): their components are those of all pairs within `distance` bits.

    Every fingerprint has all variants within half the distance (2,081 at radius 2). Variants are
    dealt out by a linear hash, so which of them fall in a bucket follows from the fingerprint's own
    label: what is shuffled is the fingerprint, once for each bucket that holds variants of it, and
    the bucket's task makes the variants, slice by slice. With more fingerprints there are more
    buckets, so a bucket's group stays bounded, and a fingerprint is dealt at most once for each of
    its variants, in passes that deal 2**LEAST_BITS copies or so: there are 2 ** 5 passes at most,
    however many fingerprints, and the disk used at a time stays in proportion to them. distance must
    be even.
    """
    if distance % 2:
        raise ValueError("distance must be even")
    radius = distance // 2
    bits, passes = bucket_bits(fps.count(), radius)

    def dealt(parts: Iterator[pa.RecordBatch], nth: int) -> Iterator[pa.RecordBatch]:
        for part in parts:
            buckets, own = deal(part.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits, passes, nth, radius)
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array([x.tobytes() for x in own], pa.binary())], ["bucket", "fps"])

    def meet(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        own = np.frombuffer(b"".join(group.column("fps").to_pylist()), np.uint64)
        a, b = collide(own, bucket, bits, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    out = None
    for k in range(1 << passes):
        copies = fps.select("fp").mapInArrow(lambda parts, nth=k: dealt(parts, nth), "bucket long, fps binary")
        links = scratch.settle(copies.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct(), f"pass{k}")
        out = links if out is None else out.union(links)
    return out


def near_groups(rows: DataFrame, scratch: Scratch, least: Column, distance: int = DISTANCE, links: DataFrame | None = None) -> DataFrame:
    """rows (with fp) and `least`: the least value of the column `least` over all rows that links of at most `distance` bits reach, or those given."""
    rows = scratch.settle(rows.withColumn("least", least).withColumn("salt", salt("least", F.spark_partition_id())), "rows")
    nodes = totals(rows, "fp", "least", ("own", F.min("least"), F.min("own")))
    nodes = scratch.settle(nodes, "nodes")
    each = nodes.groupBy("fp").agg(F.first("own").alias("own"))
    roots = components(near_links(each.select("fp"), scratch, distance) if links is None else links, scratch)
    rooted = scratch.settle(
        each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "own", F.coalesce("root", "fp").alias("root"), salt("fp").alias("salt")), "rooted"
    )
    best = totals(rooted, "root", "fp", ("best", F.min("own"), F.min("best")))
    of_fp = rooted.join(best, ["root", "salt"]).select("fp", "best")
    of_part = nodes.select("fp", "salt").join(of_fp, "fp")
    return rows.drop("least").join(of_part, ["fp", "salt"]).drop("salt").withColumnRenamed("best", "least")


def simhash_components(docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Near-duplicate groups of docs (doc_id, text): doc_id, fp, component_id (smallest doc_id that links reach).

    A null text counts as empty; texts without words have fingerprint zero and are linked like others.
    Equal rows are linked and each has its row; an empty table gives no rows; a null doc_id comes
    after all ids. No bucket or group is cut.
    """
    rows = near_groups(fingerprints(docs, shingle), scratch, F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)), distance)
    found = F.when(F.col("least") < F.lit((1 << 63) - 1), F.col("least"))
    return rows.select("doc_id", "fp", found.alias("component_id"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"), Scratch(spark, "op8"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup as a pipeline stage: of each group the row with the least doc_id (then text hash) stays.

    A null text counts as empty; texts without words are one group. Rows that repeat leave one, the
    least as JSON; a null doc_id comes after all ids. An empty table gives an empty one. Columns can
    have any names and types.
    """
    scratch = Scratch(spark, "stage-simhash")
    rows = fingerprints(docs.select("doc_id", "text", text_hash(F.col("text")).alias("text_hash")), keys=("doc_id", "text_hash"))
    return kept_rows(docs, near_groups(rows, scratch, id_order()), scratch)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def id_order() -> Column:
    """doc_id (null last), then text_hash."""
    return F.struct(F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("id"), F.col("text_hash").alias("text"))


def kept_rows(docs: DataFrame, grouped: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs that are the least of their group (doc_id, text_hash, least: id, text), once each."""
    stays = (F.coalesce("doc_id", F.lit((1 << 63) - 1)) == F.col("least.id")) & (F.col("text_hash") == F.col("least.text"))
    kept = scratch.settle(grouped.where(stays).groupBy(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_text")).agg(F.count("*").alias("copies")), "kept")
    own = whole_rows(docs).withColumns({"id": F.col("row.doc_id").cast("long"), "h": text_hash(F.col("row.text"))})
    on = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_text"))
    single = own.join(kept.where("copies = 1").drop("copies"), on, "left_semi").select("row.*")
    repeated = kept.where("copies > 1").drop("copies")
    if repeated.isEmpty():
        return single
    return single.union(least_rows(own.join(repeated, on, "left_semi"), ["id", "h"]).select("row.*"))
