"""Exact token counts of every prefix, by dynamic programming over prefixes."""

from __future__ import annotations

import array
import functools
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.llm import spans
from pelorus.llm.common import table, texts
from pelorus.llm.packing import _byte_alphabet

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Compatible pairs of tokens that are remembered.
MEMO_PAIRS = 1_500_000
CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class States(tuple):
    """Token count and last token of a word's prefixes that go on, by their length."""

    def __new__(cls):
        return super().__new__(cls, (array.array("i", [0]), array.array("i", [-1])))


class PrefixCounter:
    """Token counts under a word-level BPE vocabulary file of the tokenizers library.

    A prefix of a word has one encoding, and its last token is the one that is compatible with the
    last token of the prefix before it: two neighbours are compatible when encoding their joined
    string gives them back. So a pass over a word finds the count of each of its prefixes, and words in
    their order share the states of the prefix that they have in common. A prefix that ends a word is encoded with the word end on
    its last unit, one that goes on without it; both are kept.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.end = spec["model"]["end_of_word_suffix"]
        self.unit = {b: c for c, b in _byte_alphabet().items()}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        vocab = spec["model"]["vocab"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        self.pair = {(vocab[a] << 20) | vocab[b]: vocab[a + b] for a, b in merges}
        self.parts = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in merges}
        if any(vocab[a + b] != 512 + i for i, (a, b) in enumerate(merges)):
            raise ValueError("ids of merged tokens must follow the order of the merges")
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(self.end) and t not in self.special}
        self.final = {t[: -len(self.end)]: i for t, i in vocab.items() if t.endswith(self.end)}
        self.longest = max(map(len, vocab))
        self.fits: dict[int, bool] = {}
        self.array = np.zeros(0, np.int64)
        self.memo = spans.Memo(self._add, self._clear)

    def _clear(self) -> None:
        self.array = np.zeros(0, np.int64)

    def _add(self, new: list[str]) -> None:
        if len(self.fits) > MEMO_PAIRS:
            self.fits = {}
        made, before, states = np.zeros(len(new), np.int64), "", States()
        units = [self.units(w) for w in new]
        for i in sorted(range(len(new)), key=units.__getitem__):
            u = units[i]
            if u in self.final:
                made[i] = 1
                continue
            self._extend(states, u, len(os.path.commonprefix((before, u))))
            made[i], before = self._last(u, len(u), self.final, states)[0], u
        self.array = np.concatenate([self.array, made])

    def compatible(self, a: int, b: int) -> bool:
        """Whether the string of tokens a and b is encoded as a and b.

        Undo the merges of both, latest first, down to the units at the seam: if a merge across the
        seam ever came before the one undone, it would have been made instead.
        """
        key = (a << 20) | b
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        before = 1 << 30  # merges with a lower id than this come first
        while True:
            if self.pair.get((a << 20) | b, before) < before:
                return False
            whole_a, whole_b = a not in self.parts, b not in self.parts
            if whole_a and whole_b:
                return True
            if not whole_a and (whole_b or a > b):
                before, a = a, self.parts[a][1]
            else:  # at equal rank the merge further left comes first
                before, b = b + 1, self.parts[b][0]

    def _last(self, word: str, i: int, tokens: dict[str, int], states: States) -> tuple[int, int]:
        counts, lasts = states
        for j in range(max(0, i - self.longest), i):
            token = tokens.get(word[j:i])
            if token is not None and (not j or self.compatible(lasts[j], token)):
                return counts[j] + 1, token
        raise ValueError(f"no encoding of {word[:i]!r}")

    def _extend(self, states: States, word: str, common: int = 0) -> States:
        """Make `states` those of word, keeping what it has of a common beginning with the word before."""
        counts, lasts = states
        del counts[min(common + 1, len(word)) :], lasts[min(common + 1, len(word)) :]
        for i in range(len(counts), len(word)):
            count, last = self._last(word, i, self.inner, states)
            counts.append(count)
            lasts.append(last)
        return states

    def units(self, word: str) -> str:
        return "".join(map(self.unit.__getitem__, word.encode()))

    def count(self, word: str) -> int:
        """Tokens of a whole word, as the splitter cuts it."""
        u = self.units(word)
        if u in self.final:
            return 1
        return self._last(u, len(u), self.final, self._extend(States(), u))[0]

    def word_prefixes(self, word: str) -> list[int]:
        """Tokens of a text that is the first 1, 2, ... code points of word."""
        out, u = [], self.units(word)
        states, n = self._extend(States(), u), 0
        for k in range(1, len(word) + 1):
            n += len(word[k - 1].encode())
            if word[0] == "'" and 1 < k < len(word):  # a contraction cut short is an apostrophe and letters
                if len(cut := CUT.findall(word[:k])) > 1:
                    out.append(sum(map(self.count, cut)))
                    continue
            out.append(self._last(u, n, self.final, states)[0])
        return out

    def normalise(self, text: str) -> str:
        """NFC, then each code point in lower case. (White space ends words, whatever its kind.)"""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text).replace("İ", "i̇")
        low = text.lower()
        return low if "Σ" not in text else "".join(c.lower() for c in text)  # a final sigma isn't special here

    def batch(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of all documents: end (in code points of the normalised text), cumulative count; and bounds of documents."""
        segments, owner, extra = [], [], np.zeros(len(docs), np.int64)
        for i, t in enumerate(docs):
            if "<|" in t and any(s in t for s in self.special):
                for part in self.split_special.split(t):
                    if part in self.special:
                        extra[i] += 1
                    else:
                        segments.append(self.normalise(part))
                        owner.append(i)
            else:
                segments.append(self.normalise(t))
                owner.append(i)
        cp, starts = spans.code_points(segments)
        start, end = spans.word_level_tokens(cp, starts)
        rows = self.memo.rows("".join(segments), cp, start, end) if len(start) else start
        counts = self.array[rows]
        first = np.searchsorted(np.array(owner), np.arange(len(docs) + 1))
        offset = starts[first]
        bounds = np.searchsorted(start, offset)
        total = np.concatenate([[0], np.cumsum(counts)])
        return end, total, np.stack([bounds, offset, np.append(extra, 0)])

    def prefixes(self, text: str) -> list[int]:
        """Token count of each prefix of the normalised text, from 0 code points to all (no special tokens in it)."""
        text = self.normalise(text)
        out = [0] * (len(text) + 1)
        total = at = 0
        for m in CUT.finditer(text):
            for k in range(at, m.start() + 1):
                out[k] = total
            for k, n in enumerate(self.word_prefixes(m[0]), m.start() + 1):
                out[k] = total + n
            total, at = out[m.end()], m.end()
        for k in range(at, len(text) + 1):
            out[k] = total
        return out


@functools.lru_cache(1)
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, tokenizer: str | None = None, prefixes: bool = False) -> DataFrame:
    """Token counts of docs (doc_id, text): doc_id, n_bytes, n_tokens; a null or empty text has none.

    With prefixes, also word_ends and word_counts: the end of each word in code points of the
    normalised text and the tokens up to there, which answers where a budget of tokens is used up
    without encoding again (`PrefixCounter.word_prefixes` goes on within a word). Special tokens'
    strings count as one token each; they are in n_tokens alone. Repeated rows are counted each; an
    empty table gives no rows. Memory follows the longest text and bounded memos.
    """
    path = tokenizer or _default_path()
    schema = "doc_id long, n_bytes long, n_tokens long" + ", word_ends array<long>, word_counts array<long>" * prefixes

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for part in spans.few(parts):
            ids, all_texts = part.column(0), part.column(1).to_pylist()
            for a, b in spans.batches(all_texts):
                end, total, (bounds, offset, extra) = counter.batch(all_texts[a:b])
                n = total[bounds[1:]] - total[bounds[:-1]] + extra[:-1]
                size = [len(t.encode()) for t in all_texts[a:b]]
                cols = [ids.slice(a, b - a), pa.array(size, pa.int64()), pa.array(n, pa.int64())]
                if prefixes:
                    cut = list(zip(bounds[:-1], bounds[1:], offset[:-1]))
                    cols.append(pa.array([end[s:e] - at for s, e, at in cut], pa.list_(pa.int64())))
                    cols.append(pa.array([total[s + 1 : e + 1] - total[s] for s, e, _ in cut], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in schema.split(", ")])

    return texts(docs).mapInArrow(run, schema)


def truncate_at(counts: DataFrame, budget: int) -> DataFrame:
    """Where a budget of tokens ends, from counts with prefixes: doc_id, the words and code points that fit whole."""
    fit = F.size(F.filter("word_counts", lambda c: c <= budget))
    return counts.select("doc_id", fit.alias("n_words"), F.when(fit > 0, F.element_at("word_ends", F.greatest(fit, F.lit(1)))).otherwise(0).alias("n_code_points"))


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
