"""Packing: documents into sequences of a fixed number of tokens, by best-fit decreasing."""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from pelorus.llm import spans
from pelorus.llm.common import table, texts

WINDOW = 1024
TOKENIZER = "byte_bpe_50k.json"
END = 0
#: sequence_id is the number of the partition times this, and a count within the partition.
PER_PARTITION = 1 << 33
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteEncoder:
    """Ids of texts under a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_alphabet()
        vocab = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        if any(spec["model"]["vocab"]["".join(m)] != 256 + i for i, m in enumerate(merges)):
            raise ValueError("ids of merged tokens must follow the order of the merges")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.library = Tokenizer.from_file(path)
        self.piece = tiktoken.Encoding("bytes", pat_str=r"[\s\S]+", mergeable_ranks=vocab, special_tokens={})._encode_single_piece
        self.ids = spans.Ragged()
        self.memo = spans.Memo(lambda new: self.ids.extend([self.piece(w) for w in new]), self.ids.clear)

    def encode(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids start (one entry more than texts)."""
        odd = {i for i, t in enumerate(docs) if any(s in t for s in self.special)}
        plain = [("" if i in odd else t) for i, t in enumerate(docs)]
        cp, starts = spans.code_points(plain)
        head = spans.byte_level_tokens(cp, starts)
        rows = self.memo.rows("".join(plain), cp, head, np.concatenate([head[1:], [len(cp)]]).astype(np.int64)) if len(head) else head
        ids = self.ids.gather(rows)
        ends = np.concatenate([[0], np.cumsum(self.ids.size[rows])])
        bounds = ends[np.searchsorted(head, starts)]
        if not odd:
            return ids, bounds
        parts = [ids[bounds[i] : bounds[i + 1]] for i in range(len(docs))]
        for i in odd:  # texts with a special token's string: rare, so the library's own pace will do
            parts[i] = np.array(self.library.encode(docs[i], add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@functools.lru_cache(1)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


class BestFit:
    """Open windows by the tokens they still have room for, under a segment tree that finds the tightest."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.window, self.made = window, 0

    def _count(self, room: int, step: int) -> None:
        node = self.leaves + room
        while node:
            self.tree[node] += step
            node >>= 1

    def _tightest(self, size: int) -> int:
        """The least room >= size that an open window has, or -1."""
        node = self.leaves + size
        if self.tree[node]:
            return size
        while node > 1:
            if not node & 1 and self.tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node + (not self.tree[2 * node])
                return node - self.leaves
            node >>= 1
        return -1

    def place(self, size: int) -> tuple[int, int]:
        """Window and offset for a piece; opens a window if none has the room."""
        room = self._tightest(size)
        if room < 0:
            room, to = self.window, self.made
            self.made += 1
        else:
            to = self.open[room].pop()
            self._count(room, -1)
        if left := room - size:
            self.open[left].append(to)
            self._count(left, 1)
        return to, self.window - room


def pack_pieces(sizes: list[int], window: int) -> tuple[list[tuple[int, int]], int]:
    """Best-fit decreasing: (window, offset) of each piece, and how many windows there are."""
    fit, out = BestFit(window), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        out[i] = fit.place(sizes[i])
    return out, fit.made


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """Pack the tokens of docs (doc_id, text) into sequences of at most `window` tokens.

    A document is the ids of its text and the end id 0; a null or empty text is the end id alone. Full
    windows are cut from longer documents, what is left is placed by best-fit decreasing among the
    documents of the same partition; sequence_id holds the partition's number, so a task that runs
    again makes the same sequences. Repeated rows are packed each. Returns a row per piece: doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset. An empty table gives no rows. A
    partition holds its pieces' lengths and checksums in memory, not their ids.
    """
    path = tokenizer or _default_path()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = byte_encoder(path)
        base, made = TaskContext.get().partitionId() * PER_PARTITION, 0
        pool: list[tuple] = []
        for part in spans.few(parts):
            ids_of, all_texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for a, b in spans.batches(all_texts):
                ids, bounds = enc.encode(all_texts[a:b])
                rows = []
                for doc, s, e in zip(ids_of[a:b], bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = np.append(ids[s:e], np.uint32(END)).astype("<u4")
                    for at in range(0, len(own), window):
                        size = min(window, len(own) - at)
                        row = (doc, at, size, zlib.crc32(own[at : at + size].tobytes()), len(own))
                        if size == window:
                            rows.append((*row, base + made, 0))
                            made += 1
                        else:
                            pool.append(row)
                if rows:
                    yield _batch(rows)
        placed, _ = pack_pieces([row[2] for row in pool], window)
        for k in range(0, len(pool), 10_000):
            yield _batch([(*row, base + made + to, at) for row, (to, at) in zip(pool[k : k + 10_000], placed[k : k + 10_000])])

    return texts(docs).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing as the pipeline's last stage: a row per piece."""
    return pack(docs)
