"""Gradient boosting of symmetric trees on quantised columns, for log loss.

A tree asks one question (column, border) for each of its levels, so it has 2**depth leaves. What a level, a leaf or the
early stop needs to know of the rows are sums over blocks of them: gradients by node and bin, gradients by leaf, losses. Up to
BLOCK rows are one block, and each seed is fitted in a task of its own without any job in between. Up to ROWS rows, quantised
to bytes, are blocks dealt to the processes of a seed's task, one for each core of its executor. More rows stay in
blocks over the cluster, and each question is one job for all seeds. Blocks are the same in both.
"""

from __future__ import annotations

import dataclasses
import math
import mmap
import multiprocessing
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of 8 columns that one task fits alone (64 bytes each; of more columns fewer), and rows of a block.
ROWS, BLOCK = 1 << 23, 1 << 17
#: Rows that a process works on at a time, in its cache.
CHUNK = 1 << 14
#: Width of a bucket of scores, and how many moments of it are summed: the rest of the series is below 1e-12 of a row's weight.
BUCKET, MOMENTS = 1 / 16, 6
#: Trees after which blocks are stored with their scores, so that a lost one isn't made from the first tree on.
STORE = 25


@dataclasses.dataclass(frozen=True)
class Params:
    iterations: int = 2000
    depth: int = 6
    rate: float = 0.03
    l2: float = 3.0
    borders: int = 128
    leaf_steps: int = 10
    patience: int = 100


@dataclasses.dataclass
class Tree:
    columns: list[int]
    borders: list[int]
    leaves: list[float]

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(bins.shape[1], np.uint8 if len(self.columns) <= 8 else np.int64)
        for k, (c, b) in enumerate(zip(self.columns, self.borders)):
            out |= (bins[c] > b).astype(out.dtype) << k
        return out.astype(np.int64)


@dataclasses.dataclass
class Block:
    """Quantised rows: bins (columns, rows), labels, weights, which rows are for training, and each seed's score."""

    number: int
    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray
    train: np.ndarray
    score: dict[int, np.ndarray]
    drawn: tuple | None = None  # the gradients of the tree in work, and its leaf of each row
    placed: tuple | None = None

    def leaf(self, tree: Tree) -> np.ndarray:
        asked = (*tree.columns, *tree.borders)
        if self.placed is None or self.placed[0] != asked:
            self.placed = (asked, tree.leaf(self.bins))
        return self.placed[1]

    def apply(self, seed: int, trees: Sequence[Tree]) -> None:
        for t in trees:
            self.score[seed] = self.score[seed] + np.array(t.leaves)[self.leaf(t)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.negative(x)
    with np.errstate(over="ignore"):
        np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


def borders(rows: DataFrame, names: Sequence[str], n: int) -> list[list[float]]:
    """Up to n borders of each column, at its quantiles; nulls and NaN are below all."""
    values = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in names]
    found = rows.agg(*(F.percentile_approx(v, [k / (n + 1) for k in range(1, n + 1)], 100 * n) for v in values)).first()
    return [sorted(set(x or [])) for x in found]


def quantised(columns: list[np.ndarray], cuts: list[list[float]]) -> np.ndarray:
    """Bin 0: missing; 1 + the number of borders below the value."""
    return np.stack([np.where(np.isnan(x), 0, 1 + np.searchsorted(np.array(c), x)) for x, c in zip(columns, cuts)]).astype(np.uint8 if max(map(len, cuts), default=0) < 254 else np.uint16)


# Questions about a block. Each answer is an array, and the answers of all blocks are summed.


def by_node(block: Block, seed: int, tree: Tree, nth: int, params: Params) -> np.ndarray:
    """Gradients and second derivatives by (column, node, bin), with this tree's random weights (exponential, one for each row).

    Of a tree with questions only the rows for which the last is true are summed; the others are the rest of the level before.
    """
    if block.drawn is None or block.drawn[:2] != (seed, nth):
        p = sigmoid(block.score[seed])
        noise = np.random.default_rng([seed, nth, block.number]).standard_exponential(len(p), np.float32)
        weight = block.w * block.train * noise
        block.drawn = (seed, nth, weight * (block.y - p), weight * p * (1 - p))
    width, level = params.borders + 2, max(0, len(tree.columns) - 1)
    node, values, bins = tree.leaf(block.bins), block.drawn[2:], block.bins
    if tree.columns:
        own = np.flatnonzero(node >> level)
        node, values, bins = node[own] - (1 << level), [v[own] for v in values], bins[:, own]
    node, size = node * width, width << level
    return np.stack([[np.bincount(at, v, size) for v in values] for at in (node + b for b in bins)]).reshape(len(bins), 2, -1, width)


def by_leaf(block: Block, seed: int, tree: Tree, nth: int, params: Params) -> np.ndarray:
    """Gradients and second derivatives by leaf, at the scores that the leaves give so far."""
    at = block.leaf(tree)
    p = sigmoid(block.score[seed] + np.array(tree.leaves)[at])
    weight = block.w * block.train
    return np.stack([np.bincount(at, v, 1 << params.depth) for v in (weight * (block.y - p), weight * p * (1 - p))])


def loss(block: Block, seed: int, tree: Tree, nth: int, params: Params) -> np.ndarray:
    """Log loss of the rows that aren't for training, and their weight, with this tree."""
    p = np.clip(sigmoid(block.score[seed] + np.array(tree.leaves)[block.leaf(tree)]), 1e-7, 1 - 1e-7)
    weight = block.w * ~block.train
    return np.array([-(weight * (block.y * np.log(p) + (1 - block.y) * np.log1p(-p))).sum(), weight.sum()])


def _derivatives(n: int) -> np.ndarray:
    """Row k: the coefficients of the sigmoid's k-th derivative, divided by k!, as a polynomial of the sigmoid."""
    out, one = np.zeros((n, n + 1)), np.polynomial.Polynomial([0, 1])
    for k in range(n):
        out[k, : len(one.coef)] = one.coef / math.factorial(k)
        one = one.deriv() * np.polynomial.Polynomial([0, 1, -1])
    return out


class Part:
    """A process's blocks and what it keeps of them between questions, which it answers as the functions above do.

    Of a node's two halves only the one with fewer rows (of each 64th) is summed; the other is the rest. Leaves ask ten times about
    the same rows, so their scores are summed once: moments of the scores in buckets, by leaf, which give a sum of gradients
    at any value of the leaf by the sigmoid's series about each bucket's middle.
    """

    def __init__(self, blocks: Sequence[Block], seed: int, params: Params):
        self.seed, self.params, self.width = seed, params, params.borders + 2
        self.masks = [(b.number, b.train) for b in blocks]
        own = lambda of, rows: np.concatenate([of(b)[..., b.train if rows else ~b.train] for b in blocks], axis=-1)
        bins = own(lambda b: b.bins, True)
        self.columns, self.wide = len(bins), bins.dtype
        each = 8 // bins.itemsize
        rows = np.zeros((bins.shape[1], -(-max(1, len(bins)) // each) * each), bins.dtype)
        rows[:, : len(bins)] = bins.T
        self.words = rows.view(np.uint64)
        self.y, self.w, self.score = (own(of, True) for of in (lambda b: b.y, lambda b: b.w, lambda b: b.score[seed]))
        # processes side by side wait for memory, so what is read for each tree is small
        self.y = small if (self.y == (small := self.y.astype(np.int8))).all() else self.y
        self.w = self.w if (self.w != 1).any() else np.broadcast_to(1.0, len(self.w))
        self.other = Block(0, own(lambda b: b.bins, False), *(own(of, False) for of in (lambda b: b.y, lambda b: b.w, lambda b: b.train)), {seed: own(lambda b: b.score[seed], False)})
        self.node, self.drawn = np.zeros(len(self.y), np.min_scalar_type((1 << params.depth) - 1)), np.zeros(len(self.y), complex)
        self.level = self.cells = None
        self.chunks = [(a, min(a + CHUNK, len(self.y))) for a in range(0, len(self.y), CHUNK)]

    def _bins(self, a: int, b: int) -> np.ndarray:
        return self.words[a:b].view(self.wide)

    def _begin(self, nth: int) -> np.ndarray:
        out, size, at = np.zeros((self.columns, self.width), complex), 0, 0
        noise = np.empty(len(self.y), np.float32)
        for number, mask in self.masks:
            size = int(mask.sum())
            noise[at : at + size] = np.random.default_rng([self.seed, nth, number]).standard_exponential(len(mask), np.float32)[mask]
            at += size
        self.node[:] = 0
        for a, b in self.chunks:
            p, weight, drawn, bins = sigmoid(self.score[a:b]), self.w[a:b] * noise[a:b], self.drawn[a:b], self._bins(a, b)
            drawn.real = weight * (self.y[a:b] - p)
            drawn.imag = weight * p * (1 - p)
            for c in range(self.columns):
                np.add.at(out[c], bins[:, c].astype(np.int64), drawn)
        return out[:, None]

    def _ask(self, tree: Tree) -> np.ndarray:
        """The last question moves each row to a half of its node. Sums of the half for which it is true."""
        column, border, nodes = tree.columns[-1], tree.borders[-1], self.level.shape[1]
        some = self.node[::64] + np.int64(nodes) * (self._bins(0, len(self.y))[::64, column] > border)
        false, true = np.bincount(some, minlength=2 * nodes).reshape(2, nodes)
        true = true < false
        out = np.zeros((self.columns, nodes * self.width), complex)
        at = np.empty(CHUNK, np.int64)
        for a, b in self.chunks:
            bins, node = self._bins(a, b), self.node[a:b]
            bit = bins[:, column] > border
            place = node.astype(np.int64)
            own = np.flatnonzero(true.take(place) == bit)
            drawn, rows, place, to = self.drawn[a:b].take(own), self.words[a:b].take(own, axis=0).view(self.wide), place.take(own) * self.width, at[: len(own)]
            for c in range(self.columns):
                np.add(place, rows[:, c], out=to)
                np.add.at(out[c], to, drawn)
            node += bit * node.dtype.type(nodes)
        out = out.reshape(self.level.shape)
        return np.where(true[:, None], out, self.level - out)

    def by_node(self, tree: Tree, nth: int) -> np.ndarray:
        self.cells = None
        sums = self._ask(tree) if tree.columns else self._begin(nth)
        self.level = np.concatenate([self.level - sums, sums], axis=1) if tree.columns else sums
        return np.stack([sums.real, sums.imag], axis=1)

    def _buckets(self, tree: Tree) -> tuple:
        """By leaf and bucket with rows: the leaf, the bucket's middle, coefficients of gradients and of second derivatives; by leaf: the weight of label 1."""
        column, border, leaves = tree.columns[-1], tree.borders[-1], 1 << self.params.depth
        low, high = (math.floor(f(initial=self.score[:1].sum()) / BUCKET) for f in (self.score.min, self.score.max))
        n = high - low + 1
        sums, hits = np.zeros((MOMENTS // 2, leaves * n), complex), np.zeros(leaves)
        both = np.empty(CHUNK, complex)
        for a, b in self.chunks:
            node = self.node[a:b]
            node += (self._bins(a, b)[:, column] > border) * node.dtype.type(self.level.shape[1])
            node = node.astype(np.int64)
            hits += np.bincount(node, self.w[a:b] * self.y[a:b], leaves)
            scaled = self.score[a:b] / BUCKET
            bucket = np.floor(scaled)
            off = (scaled - bucket - 0.5) * BUCKET
            cell = node * n + (bucket.astype(np.int64) - low)
            power, drawn = self.w[a:b], both[: b - a]
            for k in range(MOMENTS // 2):
                drawn.real = power
                drawn.imag = power = power * off
                power = power * off
                np.add.at(sums[k], cell, drawn)
        moments = np.stack([sums.real, sums.imag], axis=1).reshape(MOMENTS, -1)
        has = np.flatnonzero(moments[0])
        moments, series = moments[:, has], _derivatives(MOMENTS + 1)
        first = [sum(series[k, i] * moments[k] for k in range(MOMENTS)) for i in range(MOMENTS + 2)]
        second = [sum((k + 1) * series[k + 1, i] * moments[k] for k in range(MOMENTS)) for i in range(MOMENTS + 2)]
        return has // n, (has % n + low + 0.5) * BUCKET, first, second, hits

    def by_leaf(self, tree: Tree, nth: int) -> np.ndarray:
        if self.cells is None:
            self.cells = self._buckets(tree)
        leaf, middle, first, second, hits = self.cells
        p = sigmoid(middle + np.array(tree.leaves)[leaf])
        g, h = first[-1], second[-1]
        for k in range(len(first) - 2, -1, -1):
            g, h = g * p + first[k], h * p + second[k]
        return np.stack([hits - np.bincount(leaf, g, len(hits)), np.bincount(leaf, h, len(hits))])

    def loss(self, tree: Tree, nth: int) -> np.ndarray:
        return loss(self.other, self.seed, tree, nth, self.params)

    def keep(self, tree: Tree, nth: int) -> None:
        self.other.apply(self.seed, [tree])
        values = np.array(tree.leaves)
        for a, b in self.chunks:
            self.score[a:b] += values.take(self.node[a:b].astype(np.int64))


def _serve(end, others: Sequence, shared: mmap.mmap, blocks: Sequence[Block], seed: int, params: Params) -> None:
    """A process of a seed's task; it ends with the task. Answers go by shared memory, their shapes by the pipe."""
    for x in others:
        x.close()
    part = Part(blocks, seed, params)
    while True:
        try:
            name, tree, nth = end.recv()
        except EOFError:
            return
        got = getattr(part, name)(tree, nth)
        if got is not None:
            np.frombuffer(shared, count=got.size)[:] = got.ravel()
        end.send(got is not None and got.shape)


def _together(blocks: Sequence[Block], seed: int, base: float, params: Params, stop: bool, cores: int) -> list[Tree]:
    """One seed's trees by several processes, each with its blocks."""
    forked, ends, made, shared = multiprocessing.get_context("fork"), [], [], []
    most = 8 * max(2 * len(blocks[0].bins) * (params.borders + 2) << max(0, params.depth - 1), 2 << params.depth)
    for k in range(min(cores, len(blocks))):
        here, there = forked.Pipe()
        shared.append(mmap.mmap(-1, most))
        made.append(forked.Process(target=_serve, args=(there, [*ends, here], shared[-1], blocks[k::cores], seed, params), daemon=True))
        made[-1].start()
        there.close()
        ends.append(here)

    def all_of(name: str, tree: Tree, nth: int) -> list:
        for x in ends:
            x.send((name, tree, nth))
        shapes = [x.recv() for x in ends]
        return [np.frombuffer(m, count=math.prod(shape)).reshape(shape) for m, shape in zip(shared, shapes) if shape]

    ask = lambda question, now, nth: {s: sum(all_of(question.__name__, t, nth)) for s, t in now.items()}
    keep = lambda now: [all_of("keep", t, 0) for t in now.values()]
    try:
        return boosted([seed], base, params, ask, keep, stop)[seed]
    finally:
        for x in ends:
            x.close()
        for x in made:
            x.join()


def best_question(sums: np.ndarray, l2: float) -> tuple[int, int]:
    """The column and border with the greatest gain over all nodes together; the first of equal ones."""
    g, h = np.cumsum(sums[:, 0], axis=2), np.cumsum(sums[:, 1], axis=2)
    right_g, right_h = g[:, :, -1:] - g, h[:, :, -1:] - h
    gain = (g**2 / (h + l2) + right_g**2 / (right_h + l2)).sum(axis=1)[:, :-1]
    return tuple(int(x) for x in np.unravel_index(np.argmax(gain), gain.shape))


def step(v: np.ndarray, g: np.ndarray, h: np.ndarray, l2: float, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Newton's step of each leaf. low and high, which are moved, hold values known to be too small or too great.

    A step past one of them goes half the way to it: where a value is far off, second derivatives vanish and steps grow without end.
    """
    np.copyto(low, v, where=g > 0)
    np.copyto(high, v, where=g < 0)
    to = v + g / (h + l2)
    past = np.where(g > 0, to >= high, (g < 0) & (to <= low))
    to[past] = (low[past] + high[past]) / 2
    return to


Ask = Callable[[Callable, dict[int, Tree], int], dict[int, np.ndarray]]


def boosted(seeds: Sequence[int], base: float, params: Params, ask: Ask, keep: Callable[[dict[int, Tree]], None], stop: bool) -> dict[int, list[Tree]]:
    """Trees of each seed. ask: sums of a question's answers by seed; keep: takes each round's trees. With stop, those up to the least loss."""
    trees: dict[int, list[Tree]] = {s: [] for s in seeds}
    best = {s: (np.inf, 0) for s in seeds}
    on = list(seeds)
    for nth in range(params.iterations):
        if not on:
            break
        now, level = {s: Tree([], [], []) for s in on}, {}
        for _ in range(params.depth):
            for s, sums in ask(by_node, now, nth).items():
                level[s] = sums = np.concatenate([level[s] - sums, sums], axis=2) if s in level else sums
                column, border = best_question(sums, params.l2)
                now[s].columns.append(column)
                now[s].borders.append(border)
        for t in now.values():
            t.leaves = [0.0] * (1 << params.depth)
        between = {s: (np.full(1 << params.depth, -np.inf), np.full(1 << params.depth, np.inf)) for s in on}
        for _ in range(params.leaf_steps):
            for s, (g, h) in ask(by_leaf, now, nth).items():
                now[s].leaves = step(np.array(now[s].leaves), g, h, params.l2, *between[s]).tolist()
        for s, t in now.items():
            t.leaves = (params.rate * np.array(t.leaves)).tolist()
            trees[s].append(t)
        if stop:
            for s, (total, weight) in ask(loss, now, nth).items():
                mean = total / weight if weight else 0.0
                if mean < best[s][0]:
                    best[s] = (mean, nth + 1)
                elif nth + 1 - best[s][1] >= params.patience:
                    on.remove(s)
        keep(now)
    return {s: t[: best[s][1]] if stop else t for s, t in trees.items()}


def fit(train: DataFrame, names: Sequence[str], seeds: Sequence[int], weight: str | None, validation: str | None, params: Params, rows: int | None = None) -> tuple[list[list[float]], float, dict[int, list[Tree]]]:
    """Borders, the first score, and each seed's trees. train has label, names, and maybe a weight and which rows are for validation.

    Rows without a label have no part. Without rows, or with one class, there are no trees.
    """
    spark = train.sparkSession
    own = train.where(F.col("label").isNotNull()).select(
        *(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(names)), F.col("label").cast("double").alias("y"),
        (F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)).alias("w"), (~F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(True)).alias("train"))
    own = own.persist(StorageLevel.MEMORY_AND_DISK)
    learned = own.where("train")
    cuts = borders(learned, [f"x{i}" for i in range(len(names))], params.borders)
    n, hits, total = own.agg(F.count("*"), F.sum(F.when(F.col("train"), F.col("y") * F.col("w"))), F.sum(F.when(F.col("train"), F.col("w")))).first()
    if not hits or hits == total:
        own.unpersist()
        return cuts, float("inf") if hits else float("-inf"), {s: [] for s in seeds}
    base = float(np.log(hits / (total - hits)))
    try:
        most = ROWS if rows is None else rows
        if n <= min(most, BLOCK):
            return cuts, base, _by_seed(own, seeds, cuts, base, params, bool(validation))
        if n * (len(names) + 56) <= most * 64:
            return cuts, base, _by_processes(own, spark, seeds, cuts, base, params, bool(validation), n)
        return cuts, base, _spread(own, spark, seeds, cuts, base, params, bool(validation), n)
    finally:
        own.unpersist()


def _block(number: int, table: pa.RecordBatch | pa.Table, cuts: list[list[float]], base: float, seeds: Sequence[int]) -> Block:
    numbers = lambda c: table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy()
    bins = quantised([numbers(f"x{i}").astype(float) for i in range(len(cuts))], cuts)
    return Block(number, bins, numbers("y").astype(float), numbers("w").astype(float), numbers("train").astype(bool), {s: np.full(bins.shape[1], base) for s in seeds})


def _by_seed(rows: DataFrame, seeds: Sequence[int], cuts: list[list[float]], base: float, params: Params, stop: bool) -> dict[int, list[Tree]]:
    def run(group: pa.Table) -> pa.Table:
        seed = group.column("seed")[0].as_py()
        order = np.lexsort([group.column(c).to_numpy() for c in group.column_names if c != "seed"])  # rows come in any order
        block = _block(0, group.take(pa.array(order)), cuts, base, [seed])
        ask = lambda question, now, nth: {s: question(block, s, t, nth, params) for s, t in now.items()}
        keep = lambda now: [block.apply(s, [t]) for s, t in now.items()]
        made = boosted([seed], base, params, ask, keep, stop)[seed]
        return pa.table({"seed": pa.array([seed] * len(made), pa.int64()), "nth": pa.array(range(len(made)), pa.int32()), **{c: pa.array([getattr(t, c) for t in made], pa.list_(k)) for c, k in (("columns", pa.int32()), ("borders", pa.int32()), ("leaves", pa.float64()))}})

    each = rows.withColumn("seed", F.explode(F.array(*(F.lit(s).cast("long") for s in seeds))))
    # a seed's fit is long and its rows are few: one task for each, which adaptive execution would put together by their size
    made = each.repartitionByRange(len(seeds), "seed").groupBy("seed").applyInArrow(run, "seed long, nth int, columns array<int>, borders array<int>, leaves array<double>")
    out: dict[int, list[Tree]] = {s: [] for s in seeds}
    for r in sorted(made.collect(), key=lambda r: r.nth):  # trees: iterations * (2**depth + 2 * depth) numbers for each seed
        out[r.seed].append(Tree(list(r.columns), list(r.borders), list(r.leaves)))
    return out


def _cores(spark, tasks: int) -> tuple[int, ResourceProfile | None]:
    """Cores for each of so many long tasks, and the profile by which a task gets them: all of an executor, or a share of the local ones."""
    sc = spark.sparkContext
    conf, executors = sc.getConf(), sc._jsc.sc().getExecutorMemoryStatus().size() - 1
    if sc.master == "local" or sc.master.startswith("local["):
        return max(1, sc.defaultParallelism // tasks), None
    own = cores = int(conf.get("spark.task.cpus", "1"))
    if conf.get("spark.executor.cores"):
        cores = int(conf.get("spark.executor.cores"))
    elif sc.master.startswith(("spark:", "local-cluster")) and executors > 0 and not conf.get("spark.default.parallelism") and sc.defaultParallelism > 2:
        cores = sc.defaultParallelism // executors  # executors have all cores of their machines
    if cores <= own or conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return own, None
    return cores, ResourceProfileBuilder().require(TaskResourceRequests().cpus(cores)).build


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """number: the block of each row. Equal rows are in one block, whatever order they come in."""
    return rows.withColumn("number", F.pmod(F.xxhash64(*rows.columns), F.lit(max(1, -(-n // BLOCK)))).cast("int"))


def _ordered(group: pa.Table) -> pa.Table:
    return group.take(pa.array(np.lexsort([group.column(c).to_numpy() for c in group.column_names if c != "number"])))


def _by_processes(rows: DataFrame, spark, seeds: Sequence[int], cuts: list[list[float]], base: float, params: Params, stop: bool, n: int) -> dict[int, list[Tree]]:
    """Quantised blocks go to a task for each seed, which has all cores of an executor; there are no jobs between questions."""
    cores, profile = _cores(spark, len(seeds))

    def pack(group: pa.Table) -> pa.Table:
        block = _block(group.column("number")[0].as_py(), _ordered(group), cuts, base, [])
        data = [pa.array([block.number], pa.int32()), pa.array([block.bins.dtype == np.uint16]), *(pa.array([v.tobytes()], pa.binary()) for v in (block.bins, block.y, block.w, block.train))]
        return pa.Table.from_arrays(data, ["number", "wide", "bins", "y", "w", "train"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[Block]] = {}
        for r in (r for part in batches for r in part.to_pylist()):
            bins = np.frombuffer(r["bins"], np.uint16 if r["wide"] else np.uint8).reshape(len(cuts), -1)
            own.setdefault(r["at"], []).append(Block(r["number"], bins, np.frombuffer(r["y"]), np.frombuffer(r["w"]), np.frombuffer(r["train"], bool), {seeds[r["at"]]: np.full(bins.shape[1], base)}))
        for at in sorted(own):
            made = _together(sorted(own.pop(at), key=lambda b: b.number), seeds[at], base, params, stop, cores)
            yield pa.RecordBatch.from_arrays([pa.array([at] * len(made), pa.int32()), pa.array(range(len(made)), pa.int32()), *(pa.array([getattr(t, c) for t in made], pa.list_(k)) for c, k in (("columns", pa.int32()), ("borders", pa.int32()), ("leaves", pa.float64())))], ["at", "nth", "columns", "borders", "leaves"])

    blocks = _dealt(rows, n).groupBy("number").applyInArrow(pack, "number int, wide boolean, bins binary, y binary, w binary, train binary")
    each = blocks.withColumn("at", F.explode(F.array(*(F.lit(i) for i in range(len(seeds)))))).repartitionById(len(seeds), F.col("at"))
    out: dict[int, list[Tree]] = {s: [] for s in seeds}
    for r in sorted(each.mapInArrow(run, "at int, nth int, columns array<int>, borders array<int>, leaves array<double>", profile=profile).collect(), key=lambda r: r.nth):
        out[seeds[r["at"]]].append(Tree(list(r["columns"]), list(r["borders"]), list(r["leaves"])))
    return out


def _spread(rows: DataFrame, spark, seeds: Sequence[int], cuts: list[list[float]], base: float, params: Params, stop: bool, n: int) -> dict[int, list[Tree]]:
    """Blocks over the cluster; a question is one job for all seeds, whose answers (columns * nodes * bins numbers) are summed by column of the answer."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='pelorus-')}"
    root = f"{root}/boosting-{uuid.uuid4().hex}"
    fields = "number int, bins binary, wide boolean, y binary, w binary, train binary, " + ", ".join(f"s{s} binary" for s in seeds)
    dealt = _dealt(rows, n)

    def pack(block: Block) -> pa.Table:
        data = {"number": [block.number], "bins": [block.bins.tobytes()], "wide": [block.bins.dtype == np.uint16], "y": [block.y.tobytes()], "w": [block.w.tobytes()], "train": [block.train.tobytes()]}
        return pa.table(data | {f"s{s}": [block.score[s].tobytes()] for s in seeds}, schema=pa.schema([("number", pa.int32()), ("bins", pa.binary()), ("wide", pa.bool_()), *((c, pa.binary()) for c in ["y", "w", "train", *(f"s{s}" for s in seeds)])]))

    def unpack(part: pa.RecordBatch, r: int) -> Block:
        got = {c: part.column(c)[r].as_py() for c in part.schema.names}
        bins = np.frombuffer(got["bins"], np.uint16 if got["wide"] else np.uint8).reshape(len(cuts), -1)
        return Block(got["number"], bins, np.frombuffer(got["y"]), np.frombuffer(got["w"]), np.frombuffer(got["train"], bool), {s: np.frombuffer(got[f"s{s}"]) for s in seeds})

    def begin(group: pa.Table) -> pa.Table:
        return pack(_block(group.column("number")[0].as_py(), _ordered(group), cuts, base, seeds))

    stored, pending, kept = 0, {s: [] for s in seeds}, 0

    def store(df: DataFrame) -> DataFrame:
        nonlocal stored
        df.write.parquet(f"{root}/{stored}")
        stored += 1
        return spark.read.schema(fields).parquet(f"{root}/{stored - 1}")

    blocks = store(dealt.groupBy("number").applyInArrow(begin, fields))

    def ask(question: Callable, now: dict[int, Tree], nth: int) -> dict[int, np.ndarray]:
        late = {s: list(t) for s, t in pending.items()}

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for part in batches:
                for r in range(part.num_rows):
                    block = unpack(part, r)
                    for s, t in now.items():
                        block.apply(s, late[s])
                        got = question(block, s, t, nth, params)
                        total[s] = total[s] + got if s in total else got
            for s, got in total.items():
                flat = got.reshape(got.shape[0], -1)
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(flat), pa.int64()), pa.array(range(len(flat)), pa.int32()), pa.array(list(flat), pa.list_(pa.float64())), pa.array([list(got.shape[1:])] * len(flat), pa.list_(pa.int32()))], ["seed", "row", "sums", "shape"])

        made = blocks.mapInArrow(answer, "seed long, row int, sums array<double>, shape array<int>")
        add = lambda group: pa.table({c: [group.column(c)[0].as_py()] for c in ("seed", "row")} | {"sums": [np.sum([v.values.to_numpy() for v in group.column("sums")], axis=0)], "shape": [group.column("shape")[0].as_py()]}, schema=pa.schema([("seed", pa.int64()), ("row", pa.int32()), ("sums", pa.list_(pa.float64())), ("shape", pa.list_(pa.int32()))]))
        found: dict[int, dict[int, np.ndarray]] = {s: {} for s in now}
        for r in made.groupBy("seed", "row").applyInArrow(add, "seed long, row int, sums array<double>, shape array<int>").collect():
            found[r.seed][r.row] = np.array(r.sums).reshape(r.shape)
        return {s: np.stack([v[k] for k in sorted(v)]) for s, v in found.items()}

    def keep(now: dict[int, Tree]) -> None:
        nonlocal blocks, kept
        for s, t in now.items():
            pending[s].append(t)
        kept += 1
        if kept % STORE == 0:
            late = {s: list(t) for s, t in pending.items()}

            def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for part in batches:
                    for r in range(part.num_rows):
                        block = unpack(part, r)
                        for s in seeds:
                            block.apply(s, late[s])
                        yield from pack(block).to_batches()

            blocks = store(blocks.mapInArrow(moved, fields))
            for s in seeds:
                pending[s].clear()
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{stored - 2}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    out = boosted(seeds, base, params, ask, keep, stop)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return out


def margins(columns: list[np.ndarray], cuts: list[list[float]], base: float, trees: Sequence[Tree]) -> np.ndarray:
    """Scores (log odds) of rows."""
    if not len(columns[0]):
        return np.zeros(0)
    bins, out = quantised(columns, cuts), np.full(len(columns[0]), base)
    for t in trees:
        out += np.array(t.leaves)[t.leaf(bins)]
    return out
