"""SimHash near-dedup by similarity: meet-in-the-middle ball hashing of many short fingerprints, verified on shingles.

Two texts of similarity 0.8 differ in about 15 % of a SimHash's bits, 10 of 64, which no ball of a
few bits reaches. So a text has one long fingerprint, and many short ones that are drawn from its bits;
every short one has all variants within one bit, and texts that share a variant of the same short
fingerprint are candidates. Candidates are verified: first by the bits of a part of the long
fingerprint, then by the similarity of their distinct shingles, exactly.

Of a text with very many candidates the nearest are verified. Texts that lost a candidate by this ("cut") meet
again in an exact join by their rarest shingles (`rest_links`), so no link between two of them is lost.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelorus.llm import spans
from pelorus.llm.common import Scratch, components
from pelorus.llm.simhash import SEED, flips, id_order, kept_rows, label, near_groups, text_hash

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of the long fingerprint, in words of 64; the first words that go along with candidates, and how many bits of those may differ.
WORDS = 8
CHECK_WORDS = 2
CHECK_BITS = 40
RADIUS = 1
#: Records of a group, and of a cell of a larger group, that are all compared with each other; bits that tell the members of a larger group apart, and times that some of these are drawn.
FEW, CELL = 8, 16
EVEN_BITS = 48
ROUNDS = 8
#: Of a node's candidates by one short fingerprint those that go on, and of those by all of them those that are verified, besides the one with the least number; the others' nodes are left to `rest_links`.
KEEP, VERIFIED = 2, 12
#: Share of the pairs at SIMILARITY exactly that may have no variant in common, were the short fingerprints drawn apart.
MISSED = 0.001
#: Short fingerprints that one bucket holds in the mean, variants made at a time, and copies dealt out of each text in one pass.
BUCKET_FINGERPRINTS = 1 << 20
SLICE_VARIANTS = 1 << 20
PASS_COPIES = 64
#: Places by which shingles are counted, to tell rare ones from frequent ones, and ranges of places that are summed side by side.
PLACES, RANGES = 1 << 18, 64


def bit_counts(values: np.ndarray) -> np.ndarray:
    """In how many rows of values (rows, words) each bit is set: (words, 64), by adding rows bit by bit with carries."""
    total = np.zeros((values.shape[1], 64), np.int64)
    weight = 1
    while len(values):
        carries = []
        while len(values) > 16:
            n = len(values) // 3
            a, b, c = values[:n], values[n : 2 * n], values[2 * n : 3 * n]
            either = a ^ b
            carries.append((a & b) | (c & either))
            values = np.concatenate([either ^ c, values[3 * n :]])
        total += weight * np.unpackbits(values.view(np.uint8).reshape(len(values), -1, 8), axis=2, bitorder="little").reshape(len(values), -1, 64).sum(axis=0, dtype=np.int64)
        values = np.concatenate(carries) if carries else values[:0]
        weight *= 2
    return total


def sketch(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The long fingerprint of a text's distinct shingles (A-Z in lower case; fewer words make one shingle), and their 32-bit hashes, sorted.

    A bit is 1 if it is set in over half the shingles' hashes. A text without words has neither: zero, and none.
    """
    words = text.encode().lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return np.zeros(WORDS, np.uint64), np.zeros(0, np.uint32)
    joined = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    k = min(SHINGLE, len(words))
    h = xxhash.xxh64_intdigest
    values = np.unique(np.array([h(joined[a:b], SEED) for a, b in zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist())], np.uint64))
    count, other = np.zeros((WORDS, 64), np.int64), np.arange(1, WORDS + 1, dtype=np.uint64) * spans.BASE
    for at in range(0, len(values), 1 << 14):
        count += bit_counts(spans.mix(values[at : at + (1 << 14), None] ^ other))
    return np.packbits(2 * count > len(values), axis=1, bitorder="little").view(np.uint64).reshape(-1), np.unique(values.astype(np.uint32))


def missed(width: int, radius: int = RADIUS) -> float:
    """How probably texts of SIMILARITY differ in more than 2 * radius of `width` bits."""
    p = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
    return 1 - sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(2 * radius + 1))


def shape(n: int) -> tuple[int, int]:
    """For n texts the bits of a short fingerprint, so many that most variants belong to one text, and how many of them there are."""
    width = min(60, max(24, math.ceil(math.log2(max(2, n))) + 8))
    return width, math.ceil(math.log(MISSED) / math.log(missed(width)))


@functools.lru_cache(2)
def drawn(width: int, many: int) -> np.ndarray:
    """Which bits of the long fingerprint the short ones are made of: (many, width), all bits about as often."""
    rng, rows, left = np.random.default_rng(SEED), [], np.zeros(0, np.int64)
    for _ in range(many):
        if len(left) < width:
            left = np.concatenate([left, rng.permutation(np.setdiff1d(np.arange(64 * WORDS), left[:width]))])
        rows.append(left[:width])
        left = left[width:]
    return np.array(rows)


def short(long: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Short fingerprints of long ones (rows, WORDS): (rows, short ones)."""
    each = np.unpackbits(long.view(np.uint8).reshape(len(long), -1), axis=1, bitorder="little")
    out = np.zeros((len(long), len(bits)), np.uint64)
    for k in range(bits.shape[1]):
        out |= each[:, bits[:, k]].astype(np.uint64) << np.uint64(k)
    return out


RECORD = np.dtype([("value", np.uint64), ("node", np.int64), ("check", np.uint64, (CHECK_WORDS,))])


def within(at: np.ndarray, group: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group (groups stand together) that are at most `window` apart: all pairs of groups of up to window + 1."""
    for d in range(1, window + 1):
        both = np.flatnonzero(group[d:] == group[:-d])
        if not len(both):
            return
        yield at[both], at[both + d]


def nearest(node: np.ndarray, to: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the `most` nearest of their node, or lead to its least partner; a pair has one row."""
    keep = np.zeros(len(node), bool)
    for order, count in ((np.lexsort((to, far, node)), most), (np.lexsort((to, node)), 1)):
        head = np.concatenate([[True], node[order][1:] != node[order][:-1]])[: len(order)]
        nth = np.arange(len(order)) - np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
        keep[order[nth < count]] = True
    return keep


def dense_pairs(check: np.ndarray, at: np.ndarray, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a large group's records to compare: those that agree in some of the check bits that tell the group's members apart.

    What all members have in common decides most bits alike, so the bits in which they are most evenly divided are
    taken. In each round some of these are drawn, as many as split the group into cells of CELL / 2 in the mean; all
    pairs of a cell are compared, in a cell of more than CELL those next to each other. Work: ROUNDS * CELL for each member.
    """
    share = np.zeros(64 * CHECK_WORDS)
    for k in range(0, len(at), 1 << 16):
        share += np.unpackbits(np.ascontiguousarray(check[at[k : k + (1 << 16)]]).view(np.uint8), axis=1, bitorder="little").sum(axis=0)
    even = np.argsort(np.abs(share / len(at) - 0.5), kind="stable")[:EVEN_BITS]
    key = np.zeros(len(at), np.uint64)
    for k, bit in enumerate(even.tolist()):
        key |= ((check[at, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)) << np.uint64(k)
    rng = np.random.default_rng(seed)
    width = min(EVEN_BITS, max(1, math.ceil(math.log2(2 * len(at) / CELL))))
    for _ in range(ROUNDS):
        drawn = rng.permutation(EVEN_BITS)
        turned = np.zeros(len(at), np.uint64)
        for k, bit in enumerate(drawn.tolist()):  # the drawn bits in front, so that neighbours agree in more
            turned |= ((key >> np.uint64(bit)) & np.uint64(1)) << np.uint64(EVEN_BITS - 1 - k)
        order = np.argsort(turned, kind="stable")
        yield from within(at[order], turned[order] >> np.uint64(EVEN_BITS - width), CELL - 1)


def candidates(records: np.ndarray, bucket: int, bits: int, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of nodes among records that share a variant whose label is `bucket` and are near by their check bits, and how many of those differ.

    Of the records with one variant each is compared with the least node, with the one before it, and in groups of up to
    FEW with all others. The members of larger groups are compared, each in the largest that it is in, as `dense_pairs`
    says. Of a node's pairs the KEEP nearest and that with the least node go on. So a group of m has a number of
    pairs in proportion to m. A node of a larger group, or of a pair that doesn't go on, is cut: it is paired with itself.
    """
    more = max(0, math.ceil(math.log2(max(1, len(records) * len(masks) / (1 << bits) / SLICE_VARIANTS))))
    records = records[np.argsort(label(records["value"], bits + more), kind="stable")]
    own, of_mask = label(records["value"], bits + more), label(masks, bits + more)
    found = _Nearest(records)
    for slice_ in range(1 << more):
        want = (bucket | slice_ << bits) ^ of_mask
        bounds = list(zip(np.searchsorted(own, want).tolist(), np.searchsorted(own, want, "right").tolist()))
        at = np.concatenate([np.arange(a, b) for a, b in bounds])
        if len(at) < 2:
            continue
        variant = records["value"][at] ^ np.repeat(masks, [b - a for a, b in bounds])
        order = np.lexsort((records["node"][at], variant))
        at, variant = at[order], variant[order]
        head = np.concatenate([[True], variant[1:] != variant[:-1]])
        first = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        rest = np.flatnonzero(~head)
        found.add(at[rest], at[rest - 1])
        found.add(at[rest], at[first[rest]])
        size = np.diff(np.append(np.flatnonzero(head), len(at)))
        size = np.repeat(size, size)
        small = (size > 2) & (size <= FEW)
        for pair in within(at[small], first[small], FEW - 1):
            found.add(*pair)
        many = np.flatnonzero(size > FEW)
        found.cut[at[many]] = True
        many = many[np.lexsort((first[many], -size[many], at[many]))]
        many = many[np.concatenate([[True], at[many][1:] != at[many][:-1]])[: len(many)]]  # of each record its largest group
        many = many[np.argsort(first[many], kind="stable")]
        for group in np.split(many, np.flatnonzero(np.diff(first[many])) + 1):
            if len(group) > 1:
                for pair in dense_pairs(records["check"], at[group], int(variant[group[0]] & np.uint64(0x7FFFFFFF))):
                    found.add(*pair)
    return found.pairs()


class _Nearest:
    """Pairs of records, each once, of which the nearest of each record stay."""

    def __init__(self, records: np.ndarray):
        self.records, self.new, self.waiting = records, [], 0
        self.kept = np.zeros((2, 0), np.int64)  # x * records + y, differing bits
        self.cut = np.zeros(len(records), bool)  # records of which a pair may be missing

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        self.new.append(np.minimum(x, y) * len(self.records) + np.maximum(x, y))
        self.waiting += len(x)
        if self.waiting > SLICE_VARIANTS:
            self._sift()

    def _sift(self) -> None:
        pair, n = np.unique(np.concatenate([*self.new, np.zeros(0, np.int64)])), len(self.records)
        self.new, self.waiting = [], 0
        check, node = self.records["check"], self.records["node"]
        x, y = pair // n, pair % n
        far = np.bitwise_count(check[x] ^ check[y]).sum(axis=1).astype(np.int64)
        good = (far <= CHECK_BITS) & (node[x] != node[y])
        both = np.concatenate([self.kept, np.stack([pair[good], far[good]])], axis=1)
        pair, first = np.unique(both[0], return_index=True)
        far, x, y = both[1][first], pair // n, pair % n
        keep = nearest(np.concatenate([x, y]), np.concatenate([node[y], node[x]]), np.concatenate([far, far]), KEEP).reshape(2, -1).any(axis=0)
        self.kept = np.stack([pair[keep], far[keep]])
        self.cut[x[~keep]] = self.cut[y[~keep]] = True

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._sift()
        a, b = self.records["node"][self.kept[0] // len(self.records)], self.records["node"][self.kept[0] % len(self.records)]
        own = np.unique(self.records["node"][self.cut])
        return np.concatenate([np.minimum(a, b), own]), np.concatenate([np.maximum(a, b), own]), np.concatenate([self.kept[1], np.zeros(len(own), np.int64)])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (of docs), fp (a hash of the text's words), long (its long fingerprint) and shingles, as bytes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in spans.few(parts):
            fps, longs, blobs = [], [], []
            for text in part.column(2).to_pylist():
                long, own = sketch(text)
                fps.append(xxhash.xxh64_intdigest(b" ".join(text.encode().lower().split()), SEED))
                longs.append(long.tobytes())
                blobs.append(own.tobytes())
            made = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(longs, pa.binary()), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], *made], ["doc_id", "text_hash", "fp", "long", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long, long binary, shingles binary")


def candidate_links(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes (fp, long) that share a variant of a short fingerprint and are near by the long one's first words."""
    return nearest_links(nodes, scratch)[0]


def nearest_links(nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) as `candidate_links` says, and the nodes (fp) that have further ones: both ends of every pair that was left out."""
    n = nodes.count()
    width, many = shape(n)
    bits = 0
    masks = flips(RADIUS)
    masks = masks[masks < np.uint64(1 << width)]
    while n * (reach := len(np.unique(label(masks, bits)))) > BUCKET_FINGERPRINTS << bits:
        bits += 1
    each = max(1, PASS_COPIES // reach)

    def deal(parts: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
        there = np.unique(label(masks, bits))
        chosen = drawn(width, many)[first : first + each]
        for part in parts:
            for at in range(0, part.num_rows, 2000):
                some = part.slice(at, 2000)
                long = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint64).reshape(-1, WORDS)
                values = short(long, chosen)
                buckets, blobs = [], []
                for k in range(len(chosen)):
                    records = np.zeros(len(long), RECORD)
                    records["value"], records["node"], records["check"] = values[:, k], some.column(0).to_numpy(), long[:, :CHECK_WORDS]
                    to = (label(records["value"], bits)[:, None] ^ there).reshape(-1)
                    order = np.argsort(to, kind="stable")
                    head = np.flatnonzero(np.concatenate([[True], to[order][1:] != to[order][:-1]]))
                    for own in np.split(order, head[1:]):
                        buckets.append((first + k) << bits | int(to[own[0]]))
                        blobs.append(records[own // len(there)].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "records"])

    def meet(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py() & ((1 << bits) - 1)
        a, b, far = candidates(np.frombuffer(b"".join(group.column("records").to_pylist()), RECORD), bucket, bits, masks)
        spans.release()
        return pa.table({"a": a, "b": b, "far": far})

    out = None
    for k in range(0, many, each):
        dealt = nodes.select("fp", "long").mapInArrow(lambda parts, first=k: deal(parts, first), "bucket long, records binary")
        made = scratch.settle(dealt.groupBy("bucket").applyInArrow(meet, "a long, b long, far long").distinct(), f"candidates{k}")
        out = made if out is None else out.union(made)
    # each short fingerprint has kept a node's nearest; of all of them again the nearest go on
    ends = out.where("a <> b").distinct().select("a", "b", "far", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("end"))
    by_far, by_id = Window.partitionBy("end.node").orderBy("far", "end.to"), Window.partitionBy("end.node").orderBy("end.to")
    ends = scratch.settle(ends.withColumns({"n": F.row_number().over(by_far), "m": F.row_number().over(by_id)}).select("a", "b", "end.node", F.expr(f"n <= {VERIFIED} OR m = 1").alias("stays")), "ends")
    cut = out.where("a = b").select(F.col("a").alias("fp")).union(ends.where("NOT stays").select("node"))
    return scratch.settle(ends.where("stays").select("a", "b").distinct(), "candidates"), scratch.settle(cut.distinct(), "cut")


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes (fp, shingles) whose shingles have SIMILARITY or more."""
    blobs = nodes.select("fp", "shingles")
    both = pairs.join(blobs.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(blobs.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b")

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in spans.few(parts):
            good = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                least, most = sorted((len(x), len(y)))
                common = len(np.intersect1d(x, y, assume_unique=True)) if least >= SIMILARITY * most else 0
                good.append(common >= SIMILARITY * (least + most - common))
            yield pa.RecordBatch.from_arrays(part.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def rarity(nodes: DataFrame) -> np.ndarray:
    """How many shingles of nodes fall in each place (their last bits): a shingle of a place with one is in no other node."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PLACES, np.int64)
        for part in spans.few(parts):
            total += np.bincount(np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint32) & (PLACES - 1), minlength=PLACES)
        yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array([v.tobytes() for v in np.split(total, RANGES)], pa.binary())], ["nth", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v, np.int64) for v in group.column("counts").to_pylist()], axis=0)
        return pa.table({"nth": group.column("nth").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    rows = nodes.select("shingles").mapInArrow(count, "nth int, counts binary").groupBy("nth").applyInArrow(add, "nth int, counts binary").collect()
    total = np.zeros((RANGES, PLACES // RANGES), np.int64)
    for r in rows:
        total[r.nth] = np.frombuffer(r.counts, np.int64)
    return total.reshape(-1)


def rest_links(nodes: DataFrame, cut: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """All links (a, b) between cut nodes that the given links don't reach from each other: exact, nothing is left out.

    Of a set of k shingles, in one order of all shingles, one of the first k - ceil(SIMILARITY * k) + 1 is in every set of
    SIMILARITY or more to it. Rare shingles come first in that order, so what a template gives to many texts comes last. Sets
    that share such a shingle are verified if their sizes, and the shingles that follow it, are enough. Sets that links
    join already needn't meet, and a shingle whose sets are all joined goes. Work: pairs of sets not joined that share a rare shingle.
    """
    roots = components(links, scratch, "known").withColumnRenamed("node", "fp")
    own = scratch.settle(nodes.select("fp", "shingles").join(cut, "fp").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "crowded")
    if own.isEmpty():
        return links
    counts = own.sparkSession.sparkContext.broadcast(rarity(own))  # PLACES numbers, whatever the input

    def prefixes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in spans.few(parts):
            made = [[np.zeros(0, np.int64)] for _ in range(5)]
            for fp, root, blob in zip(*(c.to_pylist() for c in part.columns)):
                shingles = np.frombuffer(blob, np.uint32)
                often, k = counts.value[shingles & (PLACES - 1)], len(shingles)
                order = np.lexsort((shingles, often))[: k - math.ceil(SIMILARITY * k - 1e-9) + 1]
                at = np.flatnonzero(often[order] > 1)
                for to, v in zip(made, (shingles[order[at]].astype(np.int64), fp, root, k, at)):
                    to.append(np.broadcast_to(np.asarray(v, np.int64), len(at)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in made], ["shingle", "fp", "root", "k", "at"])

    rows = own.select("fp", "root", "shingles").mapInArrow(prefixes, "shingle long, fp long, root long, k long, at long")
    rows = scratch.settle(rows, "prefixes")
    mixed = rows.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("shingle")
    rows = rows.join(mixed, "shingle")
    x, y = (rows.select("shingle", *(F.col(c).alias(f"{side}_{c}") for c in ("fp", "root", "k", "at"))) for side in "xy")
    enough = f"x_fp < y_fp AND x_root <> y_root AND y_k >= {SIMILARITY} * x_k - 1e-6 AND x_k >= {SIMILARITY} * y_k - 1e-6"
    enough += f" AND least(x_k - x_at, y_k - y_at) >= {SIMILARITY / (1 + SIMILARITY)} * (x_k + y_k) - 1e-6"
    pairs = scratch.settle(x.join(y, "shingle").where(enough).select(F.col("x_fp").alias("a"), F.col("y_fp").alias("b")).distinct(), "rest-pairs")
    more = scratch.settle(verified(pairs, own), "rest")
    scratch.drop("prefixes", "rest-pairs", "crowded")
    return links.union(more)


def similar_links(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between nodes (fp, long, shingles) of SIMILARITY or more, verified on all their shingles."""
    near, cut = nearest_links(nodes, scratch)
    return rest_links(nodes, cut, scratch.settle(verified(near, nodes), "similar"), scratch)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup as a pipeline stage: of each group that links of SIMILARITY (five-word shingles) reach, the row with the least doc_id (then text hash) stays.

    Texts of the same words are one group, those without words (null, empty) too. Rows that repeat leave
    one, the least as JSON; a null doc_id comes after all ids; an empty table gives an empty one. Columns
    can have any names and types. A pair of the least similarity that shares no variant is missed, with a probability of
    about 0.01, more similar ones more rarely; no pair is missed for the number of a text's candidates or the size of a group.
    No pair of less similarity is linked.
    """
    scratch = Scratch(spark, "stage-similar")
    rows = scratch.settle(sketches(docs), "sketches")
    nodes = scratch.settle(rows.groupBy("fp").agg(F.first("long").alias("long"), F.first("shingles").alias("shingles")), "nodes")
    links = similar_links(nodes, scratch)
    scratch.drop("nodes", "candidates")
    return kept_rows(docs, near_groups(rows.select("doc_id", "text_hash", "fp"), scratch, id_order(), links=links), scratch)
