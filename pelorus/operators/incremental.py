"""Rolling statistics of many windows in one pass over sorted batches, with the last values of a run carried along.

A batch's windows follow from prefix moments, from running extremes of blocks as long as the window (forwards and backwards),
and from order statistics of views, so the work for a row doesn't grow with the window but for the interquartile range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATS = ("mean", "var", "min", "max", "ptp", "iqr")
#: Values of windows that are sorted at a time.
AT_ONCE = 1 << 20


def moments(v: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample variance (0 for one value) of each w consecutive values."""
    middle = float(np.mean(v))
    d = v - middle
    s, q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (d, d * d))
    s, q = s[w:] - s[:-w], q[w:] - q[:-w]
    return middle + s / w, np.maximum(0.0, q - s * s / w) / max(1, w - 1) if w > 1 else np.zeros(len(s))


def extremes(v: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Least or greatest of each w consecutive values: of the rest of one block of w and the start of the next."""
    join, fill = (np.minimum, np.inf) if least else (np.maximum, -np.inf)
    blocks = np.concatenate([v, np.full(-len(v) % w, fill)]).reshape(-1, w)
    starts = join.accumulate(blocks, axis=1).reshape(-1)
    rests = join.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(v) - w + 1
    return join(rests[:n], starts[w - 1 : w - 1 + n])


def interquartile(v: np.ndarray, w: int) -> np.ndarray:
    """Nearest-rank interquartile range of each w consecutive values; NaN below four."""
    views = np.lib.stride_tricks.sliding_window_view(v, w)
    if w < 4:
        return np.full(len(views), np.nan)
    low, high = w // 4, min(w - 1, 3 * w // 4)
    out, step = np.empty(len(views)), max(1, AT_ONCE // w)
    for at in range(0, len(views), step):
        part = np.partition(views[at : at + step], (low, high), axis=1)
        out[at : at + step] = part[:, high] - part[:, low]
    return out


def windows(v: np.ndarray, asked: Sequence[tuple[str, int]]) -> dict[tuple[str, int], np.ndarray]:
    """Of each (statistic, window) the values over v[0:w], v[1:w+1], ...; what two statistics share is made once."""
    out: dict[tuple[str, int], np.ndarray] = {}
    for w in sorted({w for _, w in asked}):
        stats = {s for s, x in asked if x == w}
        if len(v) < w:
            out |= {(s, w): np.zeros(0) for s in stats}
            continue
        if stats & {"mean", "var"}:
            out["mean", w], out["var", w] = moments(v, w)
        if stats & {"min", "max", "ptp"}:
            out["min", w], out["max", w] = extremes(v, w, True), extremes(v, w, False)
            out["ptp", w] = out["max", w] - out["min", w]
        if "iqr" in stats:
            out["iqr", w] = interquartile(v, w)
    return out


class Tail:
    """The last values of each source in the run that is being read."""

    def __init__(self, asked: dict[str, list[tuple[str, str, int, int]]]):
        self.asked = asked
        self.reach = {s: max(lag + w - 1 for _, _, w, lag in rows) for s, rows in asked.items()}
        self.clear()

    def clear(self) -> None:
        self.values = {s: np.zeros(0) for s in self.asked}

    def take(self, columns: dict[str, np.ndarray], out: dict[str, np.ndarray], rows: slice) -> None:
        """Features of rows of one run, written to out; the run's rows before were taken before."""
        for source, asked in self.asked.items():
            x = columns[source][rows]
            has = np.flatnonzero(~np.isnan(x))
            if not len(has):
                continue
            v, before = np.concatenate([self.values[source], x[has]]), len(self.values[source])
            made = windows(v, [(stat, w) for _, stat, w, _ in asked])
            at = before + np.arange(len(has))  # the place in v of each row's own value
            for name, stat, w, lag in asked:
                first = at - (lag + w - 1)
                ok = first >= 0
                out[name][rows.start + has[ok]] = made[stat, w][first[ok]]
            self.values[source] = v[max(0, len(v) - self.reach[source]) :]


def rolling_features(df: DataFrame, asked: Sequence[tuple[str, str, str, int, int]]) -> DataFrame:
    """df (with instrument, seg_run, open_time) and a column for each (name, source, statistic, window, lag).

    As features.rolling: over the most recent values of the run of a segment that end `lag` values ago, null where the source is
    null or the run has had too few; NaN counts as null. Rows of a run with one open_time stay in the order of all their sources.
    """
    by: dict[str, list[tuple[str, str, int, int]]] = {}
    for name, source, stat, w, lag in asked:
        if stat not in STATS:
            raise ValueError(f"{name}: no incremental statistic {stat}")
        by.setdefault(source, []).append((name, stat, w, lag))
    sources, names = list(by), [a[0] for a in asked]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, last = Tail(by), None
        for part in parts:
            n = part.num_rows
            if not n:
                continue
            columns = {s: part.column(s).to_numpy(zero_copy_only=False).astype(float) for s in sources}
            out = {name: np.full(n, np.nan) for name in names}
            keys = list(zip(part.column("instrument").to_pylist(), part.column("seg_run").to_pylist()))
            cuts = [0, *(i for i in range(1, n) if keys[i] != keys[i - 1]), n]
            for a, b in zip(cuts, cuts[1:]):
                if keys[a] != last:
                    tail.clear()
                    last = keys[a]
                tail.take(columns, out, slice(a, b))
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(out[name], from_pandas=True) for name in names)], schema.names)

    dealt = df.repartition("instrument", "seg_run").sortWithinPartitions("instrument", "seg_run", "open_time", *(F.col(s) for s in sources if s != "open_time"))
    return dealt.mapInArrow(run, schema)
