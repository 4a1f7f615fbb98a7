"""Language ID with a linear-chain conditional random field over words."""

from __future__ import annotations

import dataclasses
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelorus.llm import spans
from pelorus.llm.common import table

#: Bounds of what is learned from: documents of each language and, over all languages, of all.
SAMPLE_DOCS = 400
SAMPLE_ALL = 10_000
#: The chains that whole documents are cut into for learning.
CHAIN_WORDS = 48
#: Hashed n-gram features (fewer if the weights would be more than MOST_WEIGHTS), and words of each language's lexicon.
FEATURES = 1 << 17
MOST_WEIGHTS = 1 << 23
#: Numbers in the blocks' transfer matrices that are held at a time.
MOST_MOVES = 1 << 23
LEXICON = 2000
MEMO_WORDS = 300_000
NGRAMS = (1, 2, 3, 4)
BLOCK = 64
UNKNOWN = "und"
#: The pipeline drops documents in which no language has this share.
LEAST_SCORE = 0.4


def held_out(doc_id: str | Column) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def letter_words(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of letters: start, end, and where each text's words start."""
    letter = spans.char_classes()[cp] == spans.LETTER
    edge = np.zeros(len(cp) + 1, bool)
    edge[starts] = True
    before, after = np.concatenate([[False], letter]), np.concatenate([letter, [False]])
    start = np.flatnonzero(after & (~before | edge))
    return start, np.flatnonzero(before & (~after | edge)), np.searchsorted(start, starts)


@dataclasses.dataclass
class Crf:
    """Weights: a row for each hashed feature and for each language's lexicon; transitions."""

    langs: list[str]
    lexicon: dict[str, list[int]]
    weights: np.ndarray
    transitions: np.ndarray

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of all words, end to end, and how many each word has.

        N-grams with marks at the word's ends (those that touch a mark are the affixes), the affixes
        of three letters once more with the word's first or last place, the word, and the lexicons
        that hold it.
        """
        low = [w.lower() for w in words]
        cp, starts = spans.code_points([f"\x02{w}\x03" for w in low])
        size = np.diff(starts)
        owner = np.repeat(np.arange(len(low)), size)
        left = np.arange(len(cp)) - starts[owner]
        value = spans.char_values()[cp]
        ids, of = [], []
        rolled = np.zeros(len(cp), np.uint64)
        for n in range(1, max(NGRAMS) + 1):
            rolled[: len(cp) - n + 1] += value[n - 1 :] * spans.mix(np.array([n], np.uint64))[0]
            at = np.flatnonzero(left + n <= size[owner])
            if n in NGRAMS:
                ids.append(spans.mix(rolled[at] + np.uint64(n)))
                of.append(owner[at])
            if n == 4:
                edge = at[(left[at] == 0) | (left[at] + n == size[owner[at]])]
                ids.append(spans.mix(rolled[edge] + np.uint64(101)))
                of.append(owner[edge])
        ids.append(spans.hashes(cp, starts[:-1], starts[1:], 6))
        of.append(np.arange(len(low)))
        hashed = len(self.weights) - len(self.langs)
        ids = [x & np.uint64(hashed - 1) for x in ids]
        listed = [(i, hashed + lang) for i, w in enumerate(low) for lang in self.lexicon.get(w, ())]
        ids.append(np.array([f for _, f in listed], np.uint64))
        of.append(np.array([i for i, _ in listed], np.int64))
        of, ids = np.concatenate(of), np.concatenate(ids).astype(np.int64)
        order = np.argsort(of, kind="stable")
        return ids[order], np.bincount(of, minlength=len(low))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores (word, language)."""
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        many = max(1, MOST_MOVES // (32 * len(self.langs)))
        if len(words) > many:
            return np.concatenate([self.emissions(words[i : i + many]) for i in range(0, len(words), many)])
        ids, size = self.features(words)
        return np.add.reduceat(self.weights[ids], np.cumsum(size) - size, axis=0)

    def marginals(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """P(language of word | chain), for chains end to end, by forward-backward.

        Chains are cut into blocks; the blocks' transfer matrices are made side by side, then the
        messages run from block to block, then within all blocks at once. So a long chain takes
        few array operations, and the result is that of one pass from end to end.
        """
        n, labels = scores.shape
        if not n:
            return scores.astype(float)
        many = (n // BLOCK + len(sizes)) * labels * max(labels, BLOCK) > MOST_MOVES
        if many and len(sizes) > 1:
            half = len(sizes) // 2
            cut = int(sizes[:half].sum())
            return np.concatenate([self.marginals(scores[:cut], sizes[:half]), self.marginals(scores[cut:], sizes[half:])])
        block = n if many else BLOCK  # a chain too long for its blocks' matrices is one block
        step = np.exp(self.transitions - self.transitions.max())
        blocks = -(-sizes // block)
        first = np.cumsum(blocks) - blocks
        place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = (np.repeat(first, sizes) + place // block) * block + place % block
        total = int(blocks.sum())
        local = np.zeros((total * block, labels))
        real = np.zeros(total * block, bool)
        local[at] = np.exp(scores - scores.max(axis=1, keepdims=True))
        real[at] = True
        local, real = local.reshape(total, block, labels), real.reshape(total, block)
        move = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
        for t in range(block if blocks.max() > 1 else 0):
            on = real[:, t]
            new = (move[on].reshape(-1, labels) @ step).reshape(-1, labels, labels) * local[on, t][:, None, :]
            move[on] = new / new.max(axis=(1, 2), keepdims=True)
        ahead, behind = np.ones((total, labels)), np.ones((total, labels))
        for k in range(1, int(blocks.max())):
            to = first[blocks > k] + k
            new = np.einsum("bi,bij->bj", ahead[to - 1], move[to - 1])
            ahead[to] = new / new.sum(axis=1, keepdims=True)
        last = first + blocks - 1
        for k in range(1, int(blocks.max())):
            to = last[blocks > k] - k
            new = np.einsum("bij,bj->bi", move[to + 1], behind[to + 1])
            behind[to] = new / new.sum(axis=1, keepdims=True)
        out = np.zeros((total, block, labels))
        a = ahead
        for t in range(block):
            on = real[:, t]
            new = (a[on] @ step) * local[on, t]
            a[on] = new / new.sum(axis=1, keepdims=True)
            out[:, t] = a
        b = behind
        for t in range(block - 1, -1, -1):
            on = real[:, t]
            out[:, t] *= b
            new = (local[on, t] * b[on]) @ step.T
            b[on] = new / new.sum(axis=1, keepdims=True)
        out = out.reshape(-1, labels)[at]
        return out / out.sum(axis=1, keepdims=True)


def fit(chains: list[tuple[list[str], str]], epochs: int = 6, batch: int = 256, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Crf:
    """Learn a CRF from (words, language) by Adam on the exact gradient of the likelihood.

    Half of the chains are joined from two of different languages, so the transitions see switches.
    """
    chains = sorted((c for c in chains if c[0]), key=lambda c: (c[1], c[0]))
    langs = sorted({lang for _, lang in chains})
    number = {lang: i for i, lang in enumerate(langs)}
    seen = {lang: Counter() for lang in langs}
    for words, lang in chains:
        seen[lang].update(w.lower() for w in words)
    lexicon: dict[str, list[int]] = {}
    for lang in langs:
        for w, n in sorted(seen[lang].items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if n > 1:
                lexicon.setdefault(w, []).append(number[lang])
    seen.clear()
    labels = len(langs)
    hashed = FEATURES
    while hashed * labels > MOST_WEIGHTS and hashed > 1 << 10:
        hashed >>= 1
    model = Crf(langs, lexicon, np.zeros((hashed + labels, labels), np.float32), np.zeros((labels, labels)))
    if labels < 2:
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(chains))
    known: dict[str, int] = {}
    ids_of = [np.array([known.setdefault(w, len(known)) for w in chains[i][0]], np.int32) for i in order]
    rows = [(w, np.full(len(w), number[chains[i][1]], np.int32)) for i, w in zip(order, ids_of)]
    for i in range(0, len(rows) - 1, 4):
        (a, x), (b, y) = rows[i], rows[i + 1]
        p, q = len(a) // 2, len(b) // 2
        rows[i], rows[i + 1] = tuple(map(np.concatenate, ((a[:p], b[q:]), (x[:p], y[q:])))), tuple(map(np.concatenate, ((b[:q], a[p:]), (y[:q], x[p:]))))
    rows = [r for r in rows if len(r[0])]
    features, distinct = spans.Ragged(np.int32), list(known)
    for at in range(0, len(distinct), 5000):  # of each distinct word, once
        ids, size = model.features(distinct[at : at + 5000])
        features.append(ids.astype(np.int32), size)
    del known, distinct, ids_of
    params = [model.weights, model.transitions]
    mean, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for at in range(0, len(rows), batch):
            part = rows[at : at + batch]
            words, y, sizes = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part]), np.array([len(r[0]) for r in part])
            ids, size = features.gather(words), features.size[words]
            scores = np.add.reduceat(model.weights[ids], np.cumsum(size) - size, axis=0)
            wrong, moved = _gradient(model.transitions, scores, sizes, y)
            of_feature = np.repeat(wrong, size, axis=0)
            grad = np.stack([np.bincount(ids, of_feature[:, k], len(model.weights)) for k in range(labels)], 1) / len(y)
            step += 1
            for k, g in enumerate((grad + decay * model.weights, moved / len(y) + decay * model.transitions)):
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                params[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(params[k].dtype)
    return model


def _gradient(transitions: np.ndarray, scores: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the negative log likelihood: by word score, and by transition."""
    labels, chains, longest = scores.shape[1], len(sizes), int(sizes.max())
    at = np.arange(len(y)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(chains), sizes)
    local, real = np.ones((chains, longest, labels)), np.zeros((chains, longest), bool)
    local[row, at] = np.exp(scores - scores.max(axis=1, keepdims=True))
    real[row, at] = True
    step = np.exp(transitions)
    a, b = np.zeros((longest + 1, chains, labels)), np.zeros((longest + 1, chains, labels))
    a[0] = b[longest] = 1.0 / labels
    for t in range(longest):
        new = (a[t] @ step) * local[:, t]
        a[t + 1] = np.where(real[:, t, None], new / new.sum(axis=1, keepdims=True), a[t])
    for t in range(longest - 1, -1, -1):
        new = (local[:, t] * b[t + 1]) @ step.T
        b[t] = np.where(real[:, t, None], new / new.sum(axis=1, keepdims=True), b[t + 1])
    post = a[1:] * b[1:]
    post /= post.sum(axis=2, keepdims=True)
    wrong = post[at, row]
    wrong[np.arange(len(y)), y] -= 1
    into = local.transpose(1, 0, 2) * b[1:]
    total = ((a[:-1] @ step) * into).sum(axis=2, keepdims=True)
    moved = step * ((a[:-1] / total * real.T[:, :, None]).reshape(-1, labels).T @ into.reshape(-1, labels))
    inner = at[1:] > 0
    np.subtract.at(moved, (y[:-1][inner], y[1:][inner]), 1)
    start = y[at == 0]  # a chain starts from any language alike
    share = step / step.sum(axis=0)
    for k in range(labels):
        np.subtract.at(moved, (np.full(len(start), k), start), share[k, start])
    return wrong, moved


def sample_chains(docs: DataFrame) -> list[tuple[list[str], str]]:
    """All words of SAMPLE_DOCS documents of each language at most, or fewer of each where all would be over SAMPLE_ALL; in chains of CHAIN_WORDS.

    Documents are chosen by a hash of doc_id and text; those alike in both count once. Every value of
    lang is learned: a language has at least the document with the least hash. A null text or one
    without letters has no words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    labelled = docs.where(F.col("lang").isNotNull() & F.coalesce(~held_out("doc_id"), F.lit(True)))
    labelled = labelled.select("lang", text.alias("text"), F.pmod(F.xxhash64("doc_id", text, F.lit("sample")), F.lit(1 << 40)).alias("u"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("u").alias("least")).collect()
    if not counts:
        return []
    each = max(1, min(SAMPLE_DOCS, SAMPLE_ALL // len(counts)))
    # over twice as many as wanted, so that there are enough; then the first of those
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], max(r["least"] + 1, min(1 << 40, 2 * (each << 40) // r["n"] + 1)))))
    some = labelled.where(F.col("u") < share[F.col("lang")]).groupBy("lang", "u").agg(F.min("text").alias("text"))
    chosen = some.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("u"))).where(F.col("nth") <= each)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for text, lang in zip(*(c.to_pylist() for c in part.columns)):
                cp, starts = spans.code_points([text])
                start, end, _ = letter_words(cp, starts)
                for at in range(0, len(start), CHAIN_WORDS):
                    rows.append((" ".join([text[a:b] for a, b in zip(start[at : at + CHAIN_WORDS].tolist(), end[at : at + CHAIN_WORDS].tolist())]), lang))
                rows += [("", lang)] * (not len(start))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["words", "lang"])

    known: dict[str, str] = {}  # equal words are one object
    rows = chosen.select("text", "lang").mapInArrow(cut, "words string, lang string").collect()
    return [([known.setdefault(w, w) for w in r.words.split(" ")] if r.words else [], r.lang) for r in rows]


class Labeller:
    """A model with the scores of words it has met."""

    def __init__(self, model: Crf):
        self.model = model
        self.clear()
        self.memo = spans.Memo(self.add, self.clear, min(MEMO_WORDS, 4 * MOST_MOVES // max(1, len(model.langs))))

    def clear(self) -> None:
        self.scores = np.zeros((0, len(self.model.langs)), np.float32)

    def close(self) -> None:
        """Forget all words, at the end of a task."""
        self.memo.forget()
        self.clear()
        spans.release()

    def add(self, words: list[str]) -> None:
        self.scores = np.concatenate([self.scores, self.model.emissions(words)])

    def label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words' start, end and marginals, and where each text's words start."""
        cp, starts = spans.code_points(texts)
        start, end, first = letter_words(cp, starts)
        rows = self.memo.rows("".join(texts), cp, start, end) if len(start) else start
        sizes = np.diff(first)
        return start - np.repeat(starts[:-1], sizes), end - np.repeat(starts[:-1], sizes), self.model.marginals(self.scores[rows], sizes[sizes > 0]), first


def identify(docs: DataFrame, model: Crf, segments: bool = False) -> DataFrame:
    """The language of each text of docs (doc_id, text): doc_id, lang_pred, score.

    Words are runs of letters. A document's language is the one with the largest share of its words'
    marginals, weighted by their letters (of equal shares the first in the order of names); score is that share. A text that is null or has no letter,
    and any text under a model that learned no language, is `und` with score 0. With segments also
    the runs of words of one language: lang, start and end in code points. Repeated rows have each
    their row, an empty table none.
    """
    schema = "doc_id long, lang_pred string, score double" + ", segments array<struct<lang: string, start: long, end: long>>" * segments
    run_type = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for part in spans.few(parts):
            ids, texts = part.column(0), part.column(1).to_pylist()
            for a, b in spans.batches(texts):
                pred, score, runs = [UNKNOWN] * (b - a), np.zeros(b - a), [[] for _ in range(b - a)]
                if model.langs:
                    start, end, post, first = labeller.label(texts[a:b])
                    has = np.flatnonzero(np.diff(first))
                    if len(has):
                        letters = (end - start)[:, None]
                        mass = np.add.reduceat(post * letters, first[has], axis=0)
                        mass /= mass.sum(axis=1, keepdims=True)
                        score[has] = np.minimum(1.0, mass.max(axis=1))
                        for i, k in zip(has.tolist(), mass.argmax(axis=1).tolist()):
                            pred[i] = model.langs[k]
                    if segments:
                        best = post.argmax(axis=1)
                        for i in has.tolist():
                            s, e = first[i], first[i + 1]
                            cut = s + np.flatnonzero(np.diff(best[s:e], prepend=-1))
                            runs[i] = [{"lang": model.langs[best[x]], "start": int(start[x]), "end": int(end[y - 1])} for x, y in zip(cut, [*cut[1:], e])]
                cols = [ids.slice(a, b - a), pa.array(pred, pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(runs, run_type)] * segments, ["doc_id", "lang_pred", "score", "segments"][: 3 + segments])
        labeller.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(sample_chains(docs)))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID as a pipeline stage: documents without letters, or without a language that has LEAST_SCORE of them, go.

    A null text has no letters. Without any label all documents with letters stay. Rows that repeat
    are judged alike; an empty table gives an empty one. All columns stay as they are.
    """
    model = fit(sample_chains(docs))
    names = docs.columns
    lettered = F.regexp_like(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"\p{L}"))
    if not model.langs:
        return docs.where(lettered)

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, column = Labeller(model), names.index("text")
        for part in spans.few(parts):
            texts = [t or "" for t in part.column(column).to_pylist()]
            good = np.zeros(len(texts), bool)
            for a, b in spans.batches(texts):
                start, end, post, first = labeller.label(texts[a:b])
                has = np.flatnonzero(np.diff(first))
                if len(has):
                    mass = np.add.reduceat(post * (end - start)[:, None], first[has], axis=0)
                    good[a + has] = mass.max(axis=1) >= LEAST_SCORE * mass.sum(axis=1)
            yield part.filter(pa.array(good))
        labeller.close()

    return docs.mapInArrow(keep, docs.schema)
