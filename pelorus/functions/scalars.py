"""Domain types as checked columns, returns and time algebra."""

from __future__ import annotations

import dataclasses
import statistics

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL = statistics.NormalDist()
NS_PER_MS = 1_000_000


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def is_price(c: Column) -> Column:
    return finite(c) & (c > 0)


def is_quantity(c: Column) -> Column:
    return finite(c) & (c >= 0)


def is_probability(c: Column) -> Column:
    return finite(c) & c.between(0.0, 1.0)


def is_log_return(c: Column) -> Column:
    """Infinities are allowed: no stop."""
    return c.isNotNull() & ~F.isnan(c)


def checked(c: Column, ok: Column, what: str) -> Column:
    """c, or a failure of the query where `ok` doesn't hold."""
    return F.when(ok, c).otherwise(F.raise_error(F.concat(F.lit(f"not a {what}: "), F.coalesce(c.cast("string"), F.lit("null")))))


def price(c: Column) -> Column:
    return checked(c, is_price(c), "price")


def quantity(c: Column) -> Column:
    return checked(c, is_quantity(c), "quantity")


def probability(c: Column) -> Column:
    return checked(c, is_probability(c), "probability")


def log_return_to(a: Column, b: Column) -> Column:
    return F.log(b / a)


def from_bps(c: Column) -> Column:
    return c * 1e-4


def from_pct(c: Column) -> Column:
    return F.log1p(c)


def to_bps(c: Column) -> Column:
    return c * 1e4


def to_pct(c: Column) -> Column:
    return F.exp(c) - 1


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a timestamp without zone, taken as UTC whatever the session's zone is."""
    return F.unix_millis(F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp"))


def timestamp_ns(ms: Column) -> Column:
    return ms.cast("long") * NS_PER_MS


def floor_div(a: Column, b: int) -> Column:
    """floor(a / b) of longs, exactly: nanoseconds since 1970 have 61 bits, a double 53."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def ns_to_ms(ns: Column) -> Column:
    return floor_div(ns, NS_PER_MS)


def duration_ns(value: float, unit: str) -> int:
    return int(value * {"ns": 1, "ms": 10**6, "seconds": 10**9, "minutes": 60 * 10**9, "hours": 3600 * 10**9, "days": 86_400 * 10**9}[unit])


def in_window(t: Column, start: Column, end: Column) -> Column:
    """Half-open: start <= t < end."""
    return (t >= start) & (t < end)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 < e2) & (s2 < e1)


def intersection(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The common window, or null."""
    s, e = F.greatest(s1, s2), F.least(e1, e2)
    return F.when(s < e, F.struct(s.alias("start"), e.alias("end")))


def instrument(symbol: str, venue: str = "binance") -> str:
    return f"{symbol}@{venue}"


@dataclasses.dataclass(frozen=True)
class TimeWindow:
    start: int
    end: int

    def __post_init__(self):
        if self.start >= self.end:
            raise ValueError("a window must start before its end")

    def shift(self, by: int) -> TimeWindow:
        return TimeWindow(self.start + by, self.end + by)


@dataclasses.dataclass(frozen=True)
class Split:
    """A train and a test window, at least `embargo` apart."""

    train: TimeWindow
    test: TimeWindow
    embargo: int = 0
    purge: int = 0

    def __post_init__(self):
        if self.train.end + self.embargo > self.test.start:
            raise ValueError("the test window starts within the train window and its embargo")


def coverage_gap(inside: Column, nominal: float) -> Column:
    """Aggregate: empirical minus nominal coverage."""
    return F.avg(inside.cast("double")) - nominal
