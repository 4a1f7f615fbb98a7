"""SentencePiece encoding and decoding: N-best segmentations by A-star over the piece lattice."""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pelorus.llm import spans
from pelorus.llm.common import table, texts

MODEL = "piece_bpe_32k.model"
BEST = 4
#: A lattice costs more than other operators' words.
MEMO_WORDS = 900_000
MARK = "▁"
#: Below the least score of a piece, for a code point without one (it becomes bytes).
UNKNOWN_PENALTY = 10.0
USELESS = -1e8  # a score this low marks pieces that only whole text of their kind may use


class Lattice:
    """The pieces of a word by where they end: (start, score, id), where an id of -1 is a code point as bytes.

    For each position also the best and the second best score of all ways to it (Viterbi), and the last
    piece of the best way.
    """

    __slots__ = ("word", "ends", "best", "second", "back")

    def __init__(self):
        self.word, self.ends, self.best, self.second, self.back = "", [[]], [0.0], [-np.inf], [None]


class Pieces:
    """The pieces of a sentencepiece model, their scores, and lattices over them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.score = {i: float(sp.get_score(i)) for i in plain}
        self.piece = {self.text[i]: i for i in plain}
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.normalise = sp.normalize
        self.unknown = min(s for s in self.score.values() if s > USELESS) - UNKNOWN_PENALTY
        #: By last character, then the one before; under "" the id and score of the piece that starts there.
        self.trie: dict = {}
        for p, i in self.piece.items():
            node = self.trie
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = (i, self.score[i])
        self.longest = max(map(len, self.piece))
        spoken = [bytes([self.byte_of[i]]) if i in self.byte_of else t.replace(MARK, " ").encode() for i, t in enumerate(self.text)]
        self.spoken = spans.Ragged(np.uint8)
        self.spoken.extend(spoken)
        if any(a != MARK and b == MARK for p in self.piece for a, b in itertools.pairwise(p)):
            raise ValueError("a piece spans the start of a word")

    def lattice(self, word: str) -> Lattice:
        out = Lattice()
        self.extend(out, word)
        return out

    def extend(self, at: Lattice, word: str) -> None:
        """Make `at` the lattice of word, keeping what it has of a common beginning with the word before."""
        common = 0
        for x, y in zip(at.word, word):
            if x != y:
                break
            common += 1
        at.word = word
        ends, best, second, back = at.ends, at.best, at.second, at.back
        del ends[common + 1 :], best[common + 1 :], second[common + 1 :], back[common + 1 :]
        chars, trie, unknown = list(word), self.trie, self.unknown
        for j in range(common, len(chars)):
            node, own, top, next_, edge = trie, [], -np.inf, -np.inf, None
            for i in range(j, -1, -1):
                node = node.get(chars[i])
                if node is None:
                    break
                found = node.get("")
                if found is not None:
                    k, s = found
                    own.append((i, s, k))
            if "" not in trie.get(chars[j], ()):
                own.append((j, unknown, -1))
            for e in own:
                i, s, _ = e
                v = best[i] + s
                if v > top:
                    next_, top, edge = max(top, second[i] + s), v, e
                elif v > next_:
                    next_ = v
            ends.append(own)
            best.append(top)
            second.append(next_)
            back.append(edge)

    def best_path(self, at: Lattice) -> list[int]:
        ids: list[int] = []
        j = len(at.word)
        while j:
            i, _, k = at.back[j]
            ids += [k] if k >= 0 else [self.byte[b] for b in reversed(at.word[i:j].encode())]
            j = i
        ids.reverse()
        return ids

    def nbest(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a word by score, best first (fewer if there are no more).

        The forward Viterbi score of a position is the exact best of all ways to it, so a search from
        the end that always goes on with the best sum of what it has and what can come reaches the
        start with the best path first, then the second, and so on.
        """
        made = self.lattice(word)
        ends, best = made.ends, made.best
        count = itertools.count(0, -1)  # of equal sums the later one first
        heap = [(-best[-1], next(count), len(word), 0.0, None)]
        out: list[tuple[float, list[int]]] = []
        while heap and len(out) < n:
            _, _, at, got, path = heapq.heappop(heap)
            if not at:
                ids: list[int] = []
                start = 0
                while path is not None:
                    k, end, path = path
                    ids += [k] if k >= 0 else [self.byte[b] for b in word[start:end].encode()]
                    start = end
                out.append((got, ids))
                continue
            for i, s, k in ends[at]:
                heapq.heappush(heap, (-(got + s + best[i]), next(count), i, got + s, (k, at, path)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The normalised text of ids, with spaces for marks and without the space put before a text."""
        return self.spoken.gather(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")[1:]


@functools.lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def word_bounds(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with the marks before them: start, end, and where each text's words start."""
    mark = cp == ord(MARK)
    head = mark & ~np.concatenate([[False], mark[:-1]]) if len(cp) else mark
    head[starts[:-1][starts[:-1] < len(cp)]] = True
    start = np.flatnonzero(head)
    return start, np.concatenate([start[1:], [len(cp)]]).astype(np.int64) if len(start) else start, np.searchsorted(start, starts)


class Encoder:
    """N-best encodings of texts. No piece spans the start of a word, so a text's best ones are made of its words' best ones."""

    def __init__(self, path: str):
        self.pieces = pieces(path)
        self.ids = spans.Ragged()
        self.clear()
        self.memo = spans.Memo(self.add, self.clear, MEMO_WORDS)

    def clear(self) -> None:
        self.ids.clear()
        self.best, self.gap = np.zeros(0), np.zeros(0)

    def add(self, new: list[str]) -> None:
        gc.disable()  # many small lists that live on: collections would scan them again and again
        try:
            best, gap, ids = np.zeros(len(new)), np.zeros(len(new)), [[]] * len(new)
            at = Lattice()
            for i in sorted(range(len(new)), key=new.__getitem__):  # neighbours share the beginnings of their lattices
                self.pieces.extend(at, new[i])
                best[i], gap[i], ids[i] = at.best[-1], at.best[-1] - at.second[-1], self.pieces.best_path(at)
        finally:
            gc.enable()
        self.ids.extend(ids)
        self.best, self.gap = np.concatenate([self.best, best]), np.concatenate([self.gap, gap])

    def encode(self, docs: list[str], n: int) -> Iterator[tuple[np.ndarray, list[tuple[float, list[tuple[int, list[int]]]]]]]:
        """Of each text: ids of the best encoding, and the n best: score, and (place of a piece run, other ids) where they differ.

        A run's place is the number of the word within the text.
        """
        text = "".join(docs)
        cp, starts = spans.code_points(docs)
        start, end, first = word_bounds(cp, starts)
        rows = self.memo.rows(text, cp, start, end) if len(start) else start
        for i in range(len(docs)):
            own = rows[first[i] : first[i + 1]]
            yield self.ids.gather(own), self._combine(text, start[first[i] : first[i + 1]], end[first[i] : first[i + 1]], own, n)

    def _combine(self, text: str, start: np.ndarray, end: np.ndarray, rows: np.ndarray, n: int) -> list[tuple[float, list[tuple[int, list[int]]]]]:
        """The n best sums over words: only the n - 1 words whose second best loses least can differ from the best."""
        total = float(self.best[rows].sum())
        if n == 1 or not len(rows):
            return [(total, [])]
        gap = self.gap[rows]
        near = np.argsort(gap, kind="stable")[: n - 1] if len(gap) < 64 else _least(gap, n - 1)
        near = [int(k) for k in near if np.isfinite(gap[k])]
        lists = [self.pieces.nbest(text[start[k] : end[k]], n) for k in near]
        found: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for options in lists:
            merged = [(loss + options[0][0] - s, (*picks, c)) for loss, picks in found for c, (s, _) in enumerate(options)]
            found = sorted(merged, key=lambda x: x[0])[:n]
        return [(total - loss, [(near[w], lists[w][c][1]) for w, c in enumerate(picks) if c]) for loss, picks in found]


def _least(gap: np.ndarray, n: int) -> np.ndarray:
    """Places of the n least values; of equal ones the first."""
    edge = np.partition(gap, n - 1)[n - 1]
    place = np.flatnonzero(gap <= edge)
    return place[np.argsort(gap[place], kind="stable")][:n]


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, model: str | None = None, best: int = BEST) -> DataFrame:
    """N-best piece encodings of docs (doc_id, text): doc_id, ids (the best), scores (of the `best` best, best first).

    The text is normalised as the model says; a code point without a piece becomes bytes at a fixed
    penalty. A score is the sum of the pieces' scores. A null or empty text has no ids and the one
    score 0. Repeated rows have each their row; an empty table gives none. Scores are fewer than `best`
    if a text has fewer encodings.
    """
    return texts(docs).mapInArrow(_encoded(model or _default_path(), best), "doc_id long, ids array<int>, scores array<double>")


def _encoded(path: str, best: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part in spans.few(parts):
            all_texts = part.column(1).to_pylist()
            for a, b in spans.batches(all_texts):
                found = list(enc.encode([enc.pieces.normalise(t) for t in all_texts[a:b]], best))
                flat = np.concatenate([ids for ids, _ in found]).astype(np.int32)
                bounds = np.concatenate([[0], np.cumsum([len(ids) for ids, _ in found])]).astype(np.int32)
                scores = [[s for s, _ in ranked] for _, ranked in found]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), pa.ListArray.from_arrays(bounds, flat), pa.array(scores, pa.list_(pa.float64()))], ["doc_id", "ids", "scores"])

    return run


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Texts of encodings (doc_id, ids): doc_id, text. Null ids give a null text."""
    path = model or _default_path()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pieces(path)
        for part in parts:
            for at in range(0, part.num_rows, 500):
                some = part.slice(at, 500)
                text = [made.decode(ids.values.to_numpy()) if ids.is_valid else None for ids in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def op9_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the N best scores, number and CRC-32 of the best ids, SHA-256 of what they decode to."""
    path = _default_path()
    docs = table(spark, sf_dir, "documents")

    encoded = _encoded(path, BEST)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pieces(path)
        for part in encoded(parts):
            ids = [x.values.to_numpy() for x in part.column(1)]
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            sha = [hashlib.sha256(made.decode(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), part.column(2), pa.array(sha, pa.string())], ["doc_id", "n_pieces", "ids_crc32", "scores", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, decoded_sha256 string")
