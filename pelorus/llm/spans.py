"""Word spans of many texts at once, as numpy arrays.

Texts lie end to end in one array of code points. Spans are found by array operations and sorted out by
a hash, and spans of one hash are compared letter by letter, so that Python handles each distinct word
of a batch once, not each occurrence, and words with one hash aren't taken for each other.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex

#: Code points handled at a time; a longer text is handled alone. Rows that are made Python objects at a time.
BATCH_CHARS = 1_000_000
BATCH_ROWS = 500
#: Code points of the spans that are hashed and compared at a time; a longer span is handled alone.
SLICE_CHARS = 1_000_000
#: Distinct words a worker remembers, and their code points for each; with more it starts afresh at the next batch.
MEMO_WORDS = 500_000
MEMO_CHARS = 14
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
ASCII_SPACE = np.array([32, 9, 10, 11, 12, 13])
BASE = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def char_classes() -> np.ndarray:
    """Of each code point: SPACE (White_Space), LETTER (L), NUMBER (N) or OTHER."""
    out = np.full(0x110000, OTHER, np.uint8)
    chars = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((SPACE, r"\p{White_Space}+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, chars):
            out[m.start() : m.end()] = kind
    return out


@functools.cache
def ascii_space() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[ASCII_SPACE] = True
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def char_values() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * BASE)


def factors(place: np.ndarray, seed: int) -> np.ndarray:
    """Odd factors for places in a span."""
    return mix((place + 1).astype(np.uint64) * BASE - mix(np.array([~seed], np.int64).view(np.uint64))) | np.uint64(1)


@functools.lru_cache(4)
def first_factors(seed: int) -> np.ndarray:
    return factors(np.arange(1 << 12), seed)


def few(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, BATCH_ROWS at a time: as Python objects they take more memory than in Arrow. After the last, memory is released."""
    for part in parts:
        for at in range(0, part.num_rows, BATCH_ROWS):
            yield part.slice(at, BATCH_ROWS)
    release()


def release() -> None:
    """Give memory that isn't in use back to the system, where the C library can: the worker goes on to other stages."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def batches(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `limit` code points, or one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and where each text starts (one entry more than texts)."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


def slices(start: np.ndarray, end: np.ndarray) -> Iterator[slice]:
    """Runs of spans with SLICE_CHARS code points together, or one longer span."""
    upto, at = np.cumsum(end - start), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_CHARS, "right")))
        yield slice(at, to)
        at = to


def inside(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all spans, end to end: the place of each code point, its place in its span, and where each span begins in these."""
    size = end - start
    first = np.cumsum(size) - size
    total = int(size.sum())
    kind = np.int32 if max(total, int(end.max()) if len(end) else 0) < 1 << 31 else np.int64
    at = np.arange(total, dtype=kind)
    return at + np.repeat((start - first).astype(kind), size), at - np.repeat(first.astype(kind), size), first


def hashes(cp: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span (which must not be empty): the sum of its letters' values times the factors of their places.

    Factors follow from the seed alone and have no structure, so two spans that weren't made for the seed
    have one hash with a probability of about 2**-60.
    """
    out = np.zeros(len(start), np.uint64)
    values, near = char_values(), first_factors(seed)
    for s in slices(start, end):
        place, within, first = inside(start[s], end[s])
        by = near[within] if (end[s] - start[s]).max() <= len(near) else factors(within, seed)
        out[s] = np.add.reduceat(values[cp[place]] * by, first)
    return mix(out + (end - start).astype(np.uint64))


def words(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs without ASCII white space: start, end, and where each text's words start."""
    free = ~ascii_space()[cp]
    edge = np.zeros(len(cp) + 1, bool)
    edge[starts] = True
    before = np.concatenate([[False], free])
    after = np.concatenate([free, [False]])
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    return start, end, np.searchsorted(start, starts)


def contractions(cp: np.ndarray, kind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Apostrophes of `first` that begin 's 't 'm 'd 're 've 'll, and the length with the apostrophe."""
    pad = np.concatenate([cp, np.zeros(2, cp.dtype)])
    a, b = pad[first + 1], pad[first + 2]
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    hit = one | two
    return first[hit], np.where(one[hit], 2, 3)


def byte_level_tokens(cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Starts of the pieces that byte-level BPE encodes apart.

    As the pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ does.
    """
    n = len(cp)
    kind = char_classes()[cp]
    head = np.zeros(n + 3, bool)
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    before = np.concatenate([np.array([255], np.uint8), kind[:-1]]) if n else kind
    before[edge[:n]] = 255
    space = kind == SPACE
    gap = np.concatenate([[False], cp[:-1] == 32]) if n else space
    gap &= ~edge[:n]
    change = kind != before
    head[:n] = change & ~(~space & gap)
    last = np.flatnonzero(space & ~np.concatenate([edge[1:n], [True]]) & np.concatenate([~space[1:], [False]]) if n else space)
    head[last] = True
    first = np.flatnonzero((cp == 39) & change & ~gap)
    at, size = _whole(*contractions(cp, kind, first), starts)
    head[at + 1] = head[at + 2] = False
    _restart(head, at, size, edge, kind)
    head[starts[:-1][starts[:-1] < n]] = True
    return np.flatnonzero(head[:n])


def _whole(at: np.ndarray, size: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contractions that end within their text."""
    inside = at + size <= starts[np.searchsorted(starts, at, "right")] if len(at) else np.zeros(0, bool)
    return at[inside], size[inside]


def _restart(head: np.ndarray, at: np.ndarray, size: np.ndarray, edge: np.ndarray, kind: np.ndarray) -> None:
    """Heads behind contractions; what stands there starts anew, unless it is within a later contraction."""
    head[at] = True
    end = at + size
    end = end[end < len(kind)]
    head[end] = True


def word_level_tokens(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the matches of 's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+."""
    n = len(cp)
    kind = char_classes()[cp]
    head = np.zeros(n + 3, bool)
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    before = np.concatenate([np.array([255], np.uint8), kind[:-1]]) if n else kind
    before[edge[:n]] = 255
    change = kind != before
    head[:n] = change | (kind == NUMBER)
    first = np.flatnonzero((cp == 39) & change)
    at, size = _whole(*contractions(cp, kind, first), starts)
    head[at + 1] = head[at + 2] = False
    _restart(head, at, size, edge, kind)
    head[starts[:-1][starts[:-1] < n]] = True
    bounds = np.flatnonzero(head[:n])
    ends = np.concatenate([bounds[1:], [n]]).astype(np.int64) if len(bounds) else bounds
    real = kind[bounds] != SPACE
    return bounds[real], ends[real]


class Slots:
    """Row numbers by 64-bit hashes, looked up and added many at a time: open addressing in two arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the keys, -1 for those that aren't there."""
        out, todo, slot, last = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._first(keys), (1 << self.bits) - 1
        while len(todo):
            row = self.rows[slot]
            hit = (row >= 0) & (self.keys[slot] == keys[todo])
            out[todo[hit]] = row[hit]
            on = (row >= 0) & ~hit
            todo, slot = todo[on], (slot[on] + 1) & last
        return out

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Keys that differ and aren't there yet."""
        while 2 * (self.used + len(keys)) > 1 << self.bits:
            old = self.rows >= 0
            known = self.keys[old], self.rows[old]
            self.__init__(self.bits + 1)
            self.add(*known)
        self.used += len(keys)
        todo, slot, last = np.arange(len(keys)), self._first(keys), (1 << self.bits) - 1
        while len(todo):
            free = np.flatnonzero(self.rows[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            own = free[first]
            self.keys[slot[own]], self.rows[slot[own]] = keys[todo[own]], rows[todo[own]]
            rest = np.ones(len(todo), bool)
            rest[own] = False
            todo, slot = todo[rest], (slot[rest] + 1) & last


class Memo:
    """Row numbers for words; `add` is called with the words that are new, `clear` before all are forgotten.

    Words are looked up by hash and then compared letter by letter; of words with one hash the second
    and further ones are looked up by themselves.
    """

    def __init__(self, add: Callable[[list[str]], None], clear: Callable[[], None], limit: int = MEMO_WORDS):
        self.add, self.clear, self.limit = add, clear, limit
        self.forget()

    def forget(self) -> None:
        self.index = Slots()
        self.other: dict[str, int] = {}
        self.letters = Ragged()

    def rows(self, text: str, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each span of `text` (whose code points are cp, and none of which is empty): the row of its word."""
        if len(self.letters.size) > self.limit or self.letters.used > MEMO_CHARS * self.limit:
            self.forget()
            self.clear()
        out = np.zeros(len(start), np.int64)
        for s in slices(start, end):
            out[s] = self._slice(text, cp, start[s], end[s])
        return out

    def _slice(self, text: str, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        codes, at, keys, hashed = distinct(cp, start, end)
        a, b = start[at], end[at]
        rows = self.index.find(keys)
        taken = rows >= 0  # by a word with that hash, or by an earlier one of these
        taken[hashed:] = True
        known = np.flatnonzero(rows >= 0)
        rows[known[self._differ(cp, a[known], b[known], rows[known])]] = -1
        new = np.flatnonzero(rows < 0)
        for i in new[taken[new]].tolist():
            rows[i] = self.other.get(text[a[i] : b[i]], -1)
        new = new[rows[new] < 0]
        if len(new):
            words = [text[x:y] for x, y in zip(a[new].tolist(), b[new].tolist())]
            rows[new] = np.arange(len(self.letters.size), len(self.letters.size) + len(new))
            self.add(words)
            place, _, _ = inside(a[new], b[new])
            self.letters.append(cp[place], b[new] - a[new])
            first = ~taken[new]
            self.index.add(keys[new[first]], rows[new[first]])
            for i in np.flatnonzero(~first).tolist():
                self.other[words[i]] = int(rows[new[i]])
        return rows[codes]

    def _differ(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which spans aren't the words of those rows."""
        size = end - start
        out = size != self.letters.size[rows]
        same = np.flatnonzero(~out)
        if len(same):
            place, within, first = inside(start[same], end[same])
            letters = self.letters.flat[np.repeat(self.letters.start[rows[same]].astype(within.dtype), size[same]) + within]
            out[same] = np.logical_or.reduceat(cp[place] != letters, first)
        return out


def distinct(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """A number for each span, the same for equal spans; of each number a span, and its hash; how many hashes there are.

    Spans of one hash are compared with the first of them; those that differ have numbers of their own, after all others.
    """
    codes, uniq = pd.factorize(hashes(cp, start, end))
    at = np.full(len(uniq), -1, np.int64)
    at[codes[::-1]] = np.arange(len(codes))[::-1]
    size, like = end - start, at[codes]
    other = size != size[like]
    shown = np.where(other, np.arange(len(codes)), like)
    place, _, first = inside(start, end)
    differs = cp[place] != cp[place + np.repeat((start[shown] - start).astype(place.dtype), size)]
    hashed = len(uniq)
    if differs.any() or other.any():
        other |= np.logical_or.reduceat(differs, first)
        words: dict[bytes, int] = {}
        own = np.flatnonzero(other)
        named = [words.setdefault(cp[a:b].tobytes(), len(words)) for a, b in zip(start[own].tolist(), end[own].tolist())]
        keys = uniq[codes[own]]
        codes, named = codes.copy(), np.array(named, np.int64)
        _, one = np.unique(named, return_index=True)
        codes[own] = len(uniq) + named
        at, uniq = np.concatenate([at, own[one]]), np.concatenate([uniq, keys[one]])
    return codes, at, uniq, hashed


class Ragged:
    """Growing list of integer runs in one flat array."""

    def __init__(self, dtype=np.uint32):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def extend(self, runs: list) -> None:
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        self.append(np.fromiter((x for r in runs for x in r), self.dtype, int(size.sum())), size)

    def append(self, more: np.ndarray, size: np.ndarray) -> None:
        """Runs of these sizes, end to end."""
        if self.used + len(more) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(more), len(self.flat)), self.dtype)])
        self.flat[self.used : self.used + len(more)] = more
        self.start = np.concatenate([self.start, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.used += len(more)

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The runs of `rows`, one after the other."""
        size = self.size[rows]
        before = np.cumsum(size) - size
        return self.flat[np.repeat(self.start[rows] - before, size) + np.arange(int(size.sum()))]
