"""Best-fit packing with as few sequences as possible, by linear grouping.

The plan is made for counts of lengths, of which there are at most `window` whatever the input: large lengths
are rounded up within groups of equal cardinality, a linear program over configurations of the few rounded sizes
is solved by column generation, real lengths take the rounded ones' places, and what is left goes by
best fit, in runs of like sequences. Pieces get a rank within their length from counts of parts, and find
their sequence and place in the plan's runs by it, so no task holds more than a batch of pieces.
"""

from __future__ import annotations

import bisect
import itertools
import math
import zlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelorus.llm import packing, spans
from pelorus.llm.common import Scratch, table, texts

WINDOW = 2048
#: Groups of large lengths, and the part of a window above which a length is large.
GROUPS, LARGE = 128, 1 / 4
#: Real pieces in the places of rounded ones stand if they waste no more than this part of the window, or leave a room that
#: this part of the small pieces fits in; else they are placed by best fit.
LOSS, USABLE = 0.0005, 0.25
#: Columns that the linear program may take in; its solution is one of packings at every step.
ROUNDS = 3000
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part long, nth long"
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Run(NamedTuple):
    """count pieces of a length, from rank on, one in each sequence from `sequence` on, all at one offset."""

    length: int
    rank: int
    count: int
    sequence: int
    offset: int


def grouped(counts: dict[int, int], groups: int) -> list[tuple[int, list[int]]]:
    """(rounded size, lengths of the group) from the largest down; groups have equally many pieces, as far as lengths aren't split."""
    each = -(-sum(counts.values()) // groups)
    out, before = [], 0
    for length in sorted(counts, reverse=True):
        if not out or before // each != (before + counts[length] - 1) // each and before // each != at:
            out.append((length, []))
            at = before // each
        out[-1][1].append(length)
        before += counts[length]
    return out


def best_configuration(value: np.ndarray, sizes: np.ndarray, window: int) -> tuple[float, list[int]]:
    """The multiset of sizes (indices) of the greatest value that a window holds: an unbounded knapsack, a number of items at a time."""
    best, taken = np.zeros(window + 1), []
    shown = [slice(int(s), window + 1) for s in sizes]
    for _ in range(int(window // sizes.min())):
        more, by = best.copy(), np.full(window + 1, -1)
        for g, (s, v) in enumerate(zip(sizes.tolist(), value.tolist())):
            if v > 0:
                with_it = best[: window + 1 - s] + v
                better = with_it > more[shown[g]] + 1e-12
                more[shown[g]][better] = with_it[better]
                by[shown[g]][better] = g
        best = more
        taken.append(by)
        if (by < 0).all():
            break
    room, out = window, []
    for by in reversed(taken):
        if (g := int(by[room])) >= 0:
            out.append(g)
            room -= int(sizes[g])
    return float(best[window]), out


def configurations(sizes: list[int], demand: list[int], window: int, rounds: int = ROUNDS) -> list[tuple[float, list[int]]]:
    """(times, sizes' indices): a fractional packing of the demand into the fewest windows, by column generation."""
    n, size = len(sizes), np.array(sizes)
    columns = [[g] * (window // s) for g, s in enumerate(sizes)]
    inverse = np.diag([1 / len(c) for c in columns])
    times = inverse @ np.array(demand, float)
    for _ in range(rounds):
        dual = inverse.sum(axis=0)
        worth, found = best_configuration(dual, size, window)
        if worth <= 1 + 1e-9:
            break
        column = inverse @ np.bincount(found, minlength=n)
        ratio = np.where(column > 1e-11, times / np.where(column > 1e-11, column, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        pivot = inverse[out] / column[out]
        inverse -= np.outer(column, pivot)
        inverse[out] = pivot
        times = np.maximum(times - column * ratio[out], 0)
        times[out] = ratio[out]
        columns[out] = found
    return [(float(t), c) for t, c in zip(times, columns) if t > 1e-9]


class Rooms:
    """Ranges of sequences by the room they have left."""

    def __init__(self):
        self.ranges: dict[int, deque[tuple[int, int]]] = {}
        self.rooms: list[int] = []

    def add(self, room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            if not self.ranges.setdefault(room, deque()):
                bisect.insort(self.rooms, room)
            self.ranges[room].append((first, count))

    def tightest(self, length: int) -> tuple[int, int, int] | None:
        """Take the range with the least room that holds length: room, first, count."""
        at = bisect.bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        first, count = self.ranges[room].popleft()
        if not self.ranges[room]:
            del self.rooms[at]
        return room, first, count


def plan(counts: dict[int, int], window: int = WINDOW, groups: int = GROUPS, large: float = LARGE) -> list[Run]:
    """Runs that place counts[l] pieces of each length l <= window; their number depends on lengths and groups, not on counts."""
    runs: list[Run] = []
    rooms, made = Rooms(), 0
    left = {length: deque([(0, c)]) for length, c in counts.items() if c}
    big = {length: c for length, c in counts.items() if c and length > window * large}
    if big:
        usable, back = _usable({length: c for length, c in counts.items() if length not in big}), []
        members = grouped(big, groups)
        stock = [deque((length, *left[length][0]) for length in lengths) for _, lengths in members]
        has = [sum(big[x] for x in lengths) for _, lengths in members]
        for times, items in sorted(configurations([s for s, _ in members], has, window), key=lambda x: sorted(x[1])):
            fits = min(int(times + 1e-6), *(has[g] // items.count(g) for g in set(items)))
            slots = []
            for g in items:
                has[g] -= fits
                slots.append(_take(stock[g], fits))
            while fits:
                count = min(s[0][2] for s in slots)
                taken = [_take(s, count)[0] for s in slots]
                room = window - sum(length for length, _, _ in taken)
                if LOSS * window < room < usable:
                    back += taken
                else:
                    for k, (length, rank, _) in enumerate(taken):
                        runs.append(Run(length, rank, count, made, sum(x[0] for x in taken[:k])))
                    rooms.add(room, made, count)
                    made += count
                fits -= count
        for length in big:
            left[length].clear()
        for length, rank, count in itertools.chain(back, *stock):
            left[length].append((rank, count))
    for length in sorted(left, reverse=True):
        while left[length]:
            rank, count = left[length].popleft()
            while count:
                room, first, free = rooms.tightest(length) or (window, made, -(-count // (window // length)))
                if first == made:
                    made += free
                each = room // length
                full = min(count // each, free)
                for k in range(each if full else 0):
                    runs.append(Run(length, rank + k * full, full, first, window - room + k * length))
                rooms.add(room - each * length, first, full)
                rank, count = rank + each * full, count - each * full
                if full < free and count < each:
                    for k in range(count):
                        runs.append(Run(length, rank + k, 1, first + full, window - room + k * length))
                    rooms.add(room - count * length, first + full, 1 if count else 0)
                    full, count = full + bool(count), 0
                rooms.add(room, first + full, free - full)
    return runs


def _usable(small: dict[int, int]) -> float:
    """The room that most small pieces fit in; without small ones none is of use."""
    seen, total = 0, sum(small.values())
    for length in sorted(small):
        seen += small[length]
        if seen >= total * USABLE:
            return length
    return math.inf


def _take(stock: deque, count: int) -> deque:
    out = deque()
    while count:
        length, rank, has = stock.popleft()
        out.append((length, rank, min(has, count)))
        if has > count:
            stock.appendleft((length, rank + count, has - count))
        count -= out[-1][2]
    return out


class Places:
    """Looks pieces' sequences and offsets up in a plan."""

    def __init__(self, runs: list[Run]):
        got = np.array(sorted(runs), np.int64).reshape(-1, 5)
        self.length, self.rank, _, self.sequence, self.offset = got.T
        self.first = np.searchsorted(self.length, np.arange(self.length.max(initial=0) + 2))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros((2, len(length)), np.int64)
        order = np.argsort(length, kind="stable")
        lengths, starts = np.unique(length[order], return_index=True)
        for value, own in zip(lengths.tolist(), np.split(order, starts[1:])):
            a, b = self.first[value], self.first[value + 1]
            at = a + np.searchsorted(self.rank[a:b], rank[own], "right") - 1
            sequence[own], offset[own] = self.sequence[at] + rank[own] - self.rank[at], self.offset[at]
        return sequence, offset


def pieces(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the tokens of docs, and the piece's part and number among the part's of its length."""
    path = tokenizer or packing._default_path()
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = packing.byte_encoder(path), TaskContext.get().partitionId(), [0] * (window + 1)
        for some in spans.few(parts):
            doc_ids, all_texts = some.column(0).to_pylist(), some.column(1).to_pylist()
            for a, b in spans.batches(all_texts):
                ids, bounds = enc.encode(all_texts[a:b])
                rows = []
                for doc, s, e in zip(doc_ids[a:b], bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = np.append(ids[s:e], np.uint32(packing.END)).astype("<u4")
                    cuts = [0, *range(len(own) % window or window, len(own) + 1, window)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((doc, k, x, y - x, zlib.crc32(own[x:y].tobytes()), part, seen[y - x]))
                        seen[y - x] += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return texts(docs).mapInArrow(run, PIECES)


def pack_fewest(docs: DataFrame, scratch: Scratch, window: int = WINDOW, tokenizer: str | None = None, groups: int = GROUPS, large: float = LARGE) -> DataFrame:
    """Pack the tokens of docs (doc_id, text) into as few sequences of at most `window` tokens as the plan finds.

    A document is the ids of its text and the end id 0; a null or empty text is the end id alone. Only a longer
    one is cut, into pieces of `window` tokens and before these a shorter one. Repeated rows are packed each;
    pieces of one length are alike to the plan, so ties go by part and place in it. An empty table gives no rows; very
    long texts are encoded whole; other columns don't matter. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The driver gets the count of each length, `window` numbers at most.
    """
    made = scratch.settle(pieces(docs, window, tokenizer), "pieces")
    by_part = scratch.settle(made.groupBy("length", "part").agg(F.count("*").alias("n")), "parts")
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = by_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    places = Places(plan(counts, window, groups, large))
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in parts:
            length = some.column("length").to_numpy().astype(np.int64)
            found = places.find(length, some.column("rank").to_numpy())
            kept = [some.column(c) for c in ("doc_id", "piece", "start")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(length), some.column("ids_crc32"), *map(pa.array, found)], names)

    ranked = made.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(run, SCHEMA)


def op12_fewest_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in as few sequences of 2048 tokens as linear grouping finds; see `pack_fewest` for nulls, repeats and ties."""
    return pack_fewest(table(spark, sf_dir, "documents"), Scratch(spark, "op12"))
