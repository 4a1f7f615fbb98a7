"""Substring dedup with fixed-block anchors.

Documents are cut into blocks of 7 words that don't overlap; every rolling run of 7 words of every
document probes those blocks. A window of 13 words that occurs in two documents holds a whole block of
either, so its words are among the hits. Hits are extended to all windows around them, windows are
matched by 128 bits, and windows that meet make maximal repeats. The hash of a word is keyed, with a
key drawn for each run, so no text can be made to collide: two different windows are taken for one
with a probability of about 2**-120 for each pair, whatever they hold.
"""

from __future__ import annotations

import math
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.llm import spans
from pelorus.llm.common import Scratch, table, texts

WINDOW = 13
BLOCK = (WINDOW + 1) // 2
#: Text that one task handles at a time (a longer document is handled alone), and run hashes that meet in one task.
CHUNK_BYTES = 6_000_000
PART_KEYS = 2_000_000
CHUNKS_A_FILE = 20
#: A chunk sends 2**FAN_BITS rows at most; with more parts than that, its rows meet those of other chunks on the way.
FAN_BITS = 12
NO_ID = (1 << 63) - 1


class Chunk:
    """Word hashes of some documents, end to end: 64 bits, and if exact 64 more."""

    def __init__(self, docs: pa.Table, key: int, exact: bool):
        self.ids = np.array([NO_ID if i is None else i for i in docs.column("doc_id").to_pylist()], np.int64)
        self.texts = docs.column("text").to_pylist()
        self.counts, none = np.zeros(len(self.texts), np.int64), np.zeros(0, np.uint64)
        a, b = [none], [none]
        for i, j in spans.batches(self.texts):
            cp, starts = spans.code_points(self.texts[i:j])
            start, end, first = spans.words(cp, starts)
            self.counts[i:j] = np.diff(first)
            for hashed, k in ((a, key), (b, key + 1))[: 1 + exact]:
                hashed.append(spans.hashes(cp, start, end, k))
        self.a, self.b = np.concatenate(a), np.concatenate(b)
        self.doc = np.repeat(np.arange(len(self.texts)), self.counts)
        self.end = np.cumsum(self.counts)
        self.at = np.arange(len(self.a)) - np.repeat(self.end - self.counts, self.counts)

    def starts(self, width: int) -> np.ndarray:
        """Positions where `width` words of one document start."""
        return np.flatnonzero(np.arange(len(self.doc)) + width <= self.end[self.doc]) if len(self.doc) else np.zeros(0, np.int64)


def roll(h: np.ndarray, starts: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of the `width` values from each start on."""
    factor = spans.mix(np.arange(1, width + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)
    out = np.zeros(len(starts), np.uint64)
    for i in range(width):
        out += h[starts + i] * factor[i]
    return spans.mix(out)


def chain(h: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Another one, mixed after each value, so that no sum of values can be made to agree with another."""
    out = np.full(len(starts), width, np.uint64)
    for i in range(width):
        out = spans.mix((out ^ h[starts + i]) * spans.BASE)
    return out


class Runs:
    """Distinct runs of BLOCK words of a chunk by key; the key's upper bits, of bits + 32, name the part where they meet.

    bound: where the runs begin of which the first `fan` bits are 0, 1, ...
    """

    def __init__(self, chunk: Chunk, bits: int, fan: int):
        self.starts = chunk.starts(BLOCK)
        key = roll(chunk.a, self.starts, BLOCK, 7) >> np.uint64(32 - bits)
        self.key, self.of = np.unique(key, return_inverse=True)
        n = len(self.key)
        self.anchor = np.zeros(n, bool)
        self.anchor[self.of[chunk.at[self.starts] % BLOCK == 0]] = True
        first = np.full(n, -1, np.int64)
        doc = chunk.doc[self.starts]
        first[self.of[::-1]] = doc[::-1]
        self.several = np.zeros(n, bool)
        self.several[self.of[doc != first[self.of]]] = True
        self.bound = np.searchsorted(self.key >> np.uint64(32 + bits - fan), np.arange((1 << fan) + 1, dtype=np.uint64))


class Windows:
    """Distinct windows of a chunk around hits, with the least document that has each."""

    def __init__(self, chunk: Chunk, runs: Runs, hit: np.ndarray, fan: int):
        near = np.zeros(len(chunk.a) + 1, np.int64)
        near[runs.starts[hit[runs.of]] + 1] = 1
        near = np.cumsum(near)
        starts = chunk.starts(WINDOW)
        self.starts = starts[near[starts + WINDOW - BLOCK + 1] > near[starts]]
        hi, lo = chain(chunk.a, self.starts, WINDOW), chain(chunk.b, self.starts, WINDOW)
        self.own = chunk.ids[chunk.doc[self.starts]]
        self.hi, self.lo, self.least, self.of = least_of_each(hi, lo, self.own)
        self.bound = _bound(self.hi, fan)


def least_of_each(hi: np.ndarray, lo: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of windows (hi, lo) the distinct ones, sorted, the least of `own` of each, and which of them each is."""
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    head = np.ones(len(order), bool)
    head[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    of = np.zeros(len(order), np.int64)
    of[order] = np.cumsum(head) - 1
    return hi[head], lo[head], np.minimum.reduceat(own[order], np.flatnonzero(head)) if len(order) else own, of


def _bound(hi: np.ndarray, bits: int) -> np.ndarray:
    return np.searchsorted(hi >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _cut(parts: np.ndarray) -> list[tuple[int, slice]]:
    """Runs of equal values in an ascending array."""
    head = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else parts.astype(np.int64)
    return [(int(parts[a]), slice(a, b)) for a, b in zip(head.tolist(), [*head[1:].tolist(), len(parts)])]


def _asked_runs(asker: int, key: np.ndarray, anchor: np.ndarray, several: np.ndarray, cut: list[tuple[int, slice]], low: type) -> pa.Table:
    key = key.astype(low)
    return pa.table(
        {
            "part": pa.array([p for p, _ in cut], pa.int64()),
            "asker": pa.array([asker] * len(cut), pa.int64()),
            "keys": pa.array([key[s].tobytes() for _, s in cut], pa.binary()),
            "anchor": pa.array([_bits(anchor[s]) for _, s in cut], pa.binary()),
            "several": pa.array([_bits(several[s]) for _, s in cut], pa.binary()),
        }
    )


def _asked_windows(asker: int, hi: np.ndarray, lo: np.ndarray, least: np.ndarray, cut: list[tuple[int, slice]]) -> pa.Table:
    columns = [pa.array([x[s].tobytes() for _, s in cut], pa.binary()) for x in (hi, lo, least)]
    return pa.table([pa.array([p for p, _ in cut], pa.int64()), pa.array([asker] * len(cut), pa.int64()), *columns], schema=WINDOWS)


class RunAsks:
    """The runs that askers sent to one place: all of them end to end, and the distinct ones."""

    def __init__(self, group: pa.Table, low: type):
        keys = [np.frombuffer(b, low) for b in group.column("keys").to_pylist()]
        self.sizes = [len(k) for k in keys]
        anchor, several = (np.concatenate([_flags(b, n) for b, n in zip(group.column(c).to_pylist(), self.sizes)]) for c in ("anchor", "several"))
        self.key, self.of, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        self.anchor, self.several = np.zeros(len(self.key), bool), count > 1
        self.anchor[self.of[anchor]] = True
        self.several[self.of[several]] = True


class WindowAsks:
    """The same of windows, with the least document of each."""

    def __init__(self, group: pa.Table):
        hi, lo, self.own = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("hi", np.uint64), ("lo", np.uint64), ("least", np.int64)))
        self.sizes = [len(b) // 8 for b in group.column("hi").to_pylist()]
        self.hi, self.lo, self.least, self.of = least_of_each(hi, lo, self.own)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def _told(answers: pa.Table, kind: int, bound: np.ndarray) -> np.ndarray:
    """The answers of one kind, for a chunk's distinct keys."""
    out = np.zeros(bound[-1], bool)
    for k, part, blob in zip(*(answers.column(c).to_pylist() for c in ("kind", "part", "flags"))):
        if k == kind:
            out[bound[part] : bound[part + 1]] = _flags(blob, bound[part + 1] - bound[part])
    return out


def _told_by(answers: pa.Table, parts: np.ndarray) -> np.ndarray:
    """The answers for distinct keys in ascending order, of which each has a part."""
    out, at = np.zeros(len(parts), bool), dict(_cut(parts))
    for part, blob in zip(answers.column("part").to_pylist(), answers.column("flags").to_pylist()):
        out[at[part]] = _flags(blob, at[part].stop - at[part].start)
    return out


def _answer(group: pa.Table, flags: np.ndarray, sizes: list[int], kind: int) -> pa.Table:
    """One row for each asker's row that has a true flag."""
    rows, at = [], 0
    for asker, part, n in zip(group.column("asker").to_pylist(), group.column("part").to_pylist(), sizes):
        if flags[at : at + n].any():
            rows.append((asker, part, _bits(flags[at : at + n])))
        at += n
    return pa.table({"asker": pa.array([r[0] for r in rows], pa.int64()), "part": pa.array([r[1] for r in rows], pa.int64()), "kind": pa.array([kind] * len(rows), pa.int32()), "flags": pa.array([r[2] for r in rows], pa.binary())})


ANSWER = "asker long, part long, kind int, flags binary"
RUNS = "part long, asker long, keys binary, anchor binary, several binary"


def repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Remove from docs (doc_id, text) the words of windows that also start in a document with a smaller doc_id.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged; a window is 13 consecutive words of one document, and
    windows are judged on the input. Rows that share a doc_id don't count as earlier ones of each
    other; a null doc_id comes after all ids, and null text has no words. Returns a row per row of docs:
    doc_id, n_words, n_removed, spans (maximal removed runs, as first word and word behind), kept (the
    words that stay, joined by one space). An empty table gives no rows.

    Documents are dealt to chunks, which are written once, in files by chunk, so that the three passes
    over them need no shuffle of texts; rows that repeat go to a chunk for each input partition. A chunk
    asks about each distinct run or window once, so the rows that meet for one of them are as many as
    chunks, however often it occurs. It sends 2**FAN_BITS rows at most: with more parts than that, the
    rows of many chunks for a range of parts are merged first, and go on from there. Nothing is capped;
    a false hit of a run's short key only adds windows to compare.
    """
    plain = texts(docs)
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0]
    key = secrets.randbits(60)
    chunks = max(1, math.ceil((size or 0) / CHUNK_BYTES))
    bits = max(3, math.ceil(math.log2(max(1, (size or 0) / 6 / PART_KEYS))))
    dealt = plain.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks)).cast("long"))
    files = min(chunks, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(chunks / CHUNKS_A_FILE)))
    plain = scratch.bucketed(dealt, "chunks", "chunk", files)

    fan = min(bits, FAN_BITS)
    low = np.uint64 if fan < bits else np.uint32
    near = max(1, PART_KEYS * (6 << fan) // CHUNK_BYTES)  # chunks whose rows of a first part have as many runs as a part

    def ask_runs(group: pa.Table) -> pa.Table:
        runs = Runs(Chunk(group, key, False), bits, fan)
        return _asked_runs(group.column("chunk")[0].as_py(), runs.key, runs.anchor, runs.several, _cut(runs.key >> np.uint64(32 + bits - fan)), low)

    def pass_runs(group: pa.Table) -> pa.Table:
        asks = RunAsks(group, np.uint64)
        return _asked_runs(group.column("via")[0].as_py(), asks.key, asks.anchor, asks.several, _cut(asks.key >> np.uint64(32)), np.uint32)

    def meet_runs(group: pa.Table) -> pa.Table:
        asks = RunAsks(group, np.uint32)
        return _answer(group, (asks.anchor & asks.several)[asks.of], asks.sizes, 0)

    def return_runs(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows or not group.num_rows:
            return pa.table({"asker": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "flags": pa.array([], pa.binary())})
        asks = RunAsks(group, np.uint64)
        hit = _told_by(answers, asks.key >> np.uint64(32))
        return _answer(group, hit[asks.of], asks.sizes, 0)

    def ask_windows(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows or not group.num_rows:
            return WINDOWS.empty_table()
        chunk = Chunk(group, key, True)
        runs = Runs(chunk, bits, fan)
        w = Windows(chunk, runs, _told(answers, 0, runs.bound), fan)
        return _asked_windows(group.column("chunk")[0].as_py(), w.hi, w.lo, w.least, _cut(w.hi >> np.uint64(64 - fan)))

    def pass_windows(group: pa.Table) -> pa.Table:
        asks = WindowAsks(group)
        return _asked_windows(group.column("via")[0].as_py(), asks.hi, asks.lo, asks.least, _cut(asks.hi >> np.uint64(64 - bits)))

    def meet_windows(group: pa.Table) -> pa.Table:
        asks = WindowAsks(group)
        return _answer(group, asks.least[asks.of] < asks.own, asks.sizes, 1)

    def return_windows(group: pa.Table, answers: pa.Table) -> pa.Table:
        asks = WindowAsks(group)
        flags = asks.least[asks.of] < asks.own  # an earlier document in the same group of chunks, or one that all of it follows
        if answers.num_rows and group.num_rows:
            flags |= _told_by(answers, asks.hi >> np.uint64(64 - bits))[asks.of]
        return _answer(group, flags, asks.sizes, 1)

    def meeting(asked: DataFrame, schema: str, meet, hand_on, hand_back, name: str) -> DataFrame:
        """Answers to what chunks asked; beyond 2**FAN_BITS parts by way of groups of chunks, so that rows don't get small."""
        if fan == bits:
            return scratch.settle(asked.groupBy("part").applyInArrow(meet, ANSWER), name)
        via = F.shiftleft(F.col("part"), 32).bitwiseOR(F.floor(F.col("asker") / near).cast("long"))
        asked = scratch.settle(asked.withColumn("via", via), f"{name}-asked")
        on = asked.groupBy("via").applyInArrow(hand_on, schema)
        met = scratch.settle(on.groupBy("part").applyInArrow(meet, ANSWER), f"{name}-met")
        return scratch.settle(asked.groupBy("via").cogroup(met.groupBy("asker")).applyInArrow(hand_back, ANSWER), name)

    def cut_out(group: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(group, key, bool(answers.num_rows)) if group.num_rows else None
        if chunk is None:
            return RESULT.empty_table()
        gone = np.zeros(len(chunk.a), bool)
        if answers.num_rows:
            runs = Runs(chunk, bits, fan)
            w = Windows(chunk, runs, _told(answers, 0, runs.bound), fan)
            late = _told(answers, 1, w.bound)[w.of] | (w.own > w.least[w.of])
            step = np.zeros(len(gone) + 1, np.int64)
            np.add.at(step, w.starts[late], 1)
            np.add.at(step, w.starts[late] + WINDOW, -1)
            gone = np.cumsum(step[:-1]) > 0
        removed, found, kept = [], [], []
        for text, n, end in zip(chunk.texts, chunk.counts.tolist(), chunk.end.tolist()):
            own = gone[end - n : end]
            edge = np.flatnonzero(np.diff(own, prepend=False, append=False))
            removed.append(int(own.sum()))
            found.append([{"first": a, "behind": b} for a, b in edge.reshape(-1, 2).tolist()])
            words = text.encode().split()
            kept.append(b" ".join([x for x, g in zip(words, own.tolist()) if not g] if removed[-1] else words).decode())
        return pa.table([group.column("doc_id").combine_chunks(), pa.array(chunk.counts), pa.array(removed, pa.int64()), pa.array(found, RESULT.field("spans").type), pa.array(kept, pa.string())], schema=RESULT)

    asked = plain.groupBy("chunk").applyInArrow(ask_runs, RUNS)
    hits = meeting(asked, RUNS, meet_runs, pass_runs, return_runs, "hits")
    windows = "part long, asker long, hi binary, lo binary, least binary"
    asked = plain.groupBy("chunk").cogroup(hits.groupBy("asker")).applyInArrow(ask_windows, windows)
    late = meeting(asked, windows, meet_windows, pass_windows, return_windows, "late")
    return plain.groupBy("chunk").cogroup(hits.union(late).groupBy("asker")).applyInArrow(cut_out, "doc_id long, n_words long, n_removed long, spans array<struct<first: long, behind: long>>, kept string")


WINDOWS = pa.schema([("part", pa.int64()), ("asker", pa.int64()), ("hi", pa.binary()), ("lo", pa.binary()), ("least", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("behind", pa.int64())]))), ("kept", pa.string())])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(words[s:s + 12], ' ') AS k FROM w, unnest(range(1, len(words) - 11)) t(s)
), firsts AS (
  SELECT k, min(doc_id) AS first_id FROM windows GROUP BY k
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS places FROM (
    SELECT doc_id, unnest(range(s, s + 13)) AS p FROM windows JOIN firsts USING (k) WHERE first_id < doc_id
  ) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(words, lambda x, i: NOT coalesce(list_contains(places, i), false)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
