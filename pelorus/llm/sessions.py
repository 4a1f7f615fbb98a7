"""Gap sessionisation: an automaton over each client's events in order of time, as a Python UDTF.

The automaton takes TABLE PARTITION BY client ORDER BY ts, in batches of rows. A client can have a third of all
events, so the line of time of a client with many is cut before: into hours, each of which takes the
sessions that begin in it. Where an hour's first session begins follows from the session that is open at its
start; that one is found by aggregates of hours, and by doubling where hours have no pause and no final event.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelorus.llm.common import Scratch, table

MINUTE = 60_000_000
GAP, LENGTH, LATENESS = 10 * MINUTE, 40 * MINUTE, 360 * MINUTE
FINAL_KIND, FINAL_VALUE = "error", 60.0
#: Slots that a client's line of time is cut into: an hour, and at least as long as the longest session and a gap.
SLOT = 60 * MINUTE
#: Slots that one window of the search for a slot's last piece holds.
BLOCK = 64
#: Codes of the automaton's rows; within a time they sort in this order.
CLICK, LATE, TOO_LONG, PAUSE = 0, 1, 2, 3
#: A client with more than one in so many rows is cut into pieces.
HEAVY_SHARE = 512
#: Sessions that the automaton holds before it hands them on.
EMIT = 10_000
FED = "client_id us code click_id final cents".split()
SCHEMA = "client_id long, session_id long, start_us long, end_us long, n_clicks long, n_late long, value_cents long, closed_by string, path_sha256 string"


def micros(name: str) -> Column:
    """Microseconds since 1970 of a time without a zone, whatever the session's zone is."""
    t = F.col(name).cast("timestamp_ntz")
    whole = F.unix_date(t.cast("date")).cast("long") * 86_400 + F.hour(t) * 3_600 + F.minute(t) * 60
    return whole * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def events(clicks: DataFrame, lateness_us: int = LATENESS) -> DataFrame:
    """client_id, us, late, click_id, final, cents: one row for each click_id that has a client and a ts.

    Rows without a click_id can't be told apart and are left out. Of rows of one click_id that differ, the
    least in (us, client_id, arrived_at, kind, value) counts. A null arrived_at isn't late; a null kind or value isn't
    final; NaN counts as null, and null is worth nothing.
    """
    value = F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))
    rows = clicks.where("click_id IS NOT NULL AND ts IS NOT NULL AND client_id IS NOT NULL").select(
        F.col("click_id").cast("long").alias("click_id"), F.col("client_id").cast("long").alias("client_id"), micros("ts").alias("us"),
        F.when(F.col("arrived_at").isNotNull(), micros("arrived_at")).alias("arrived"),
        F.coalesce((F.col("kind") == FINAL_KIND) & (value >= FINAL_VALUE), F.lit(False)).alias("final"),
        F.when(value.isNull(), 0).otherwise(F.floor(value * 100 + 0.5)).alias("cents"),
    )
    least = Window.partitionBy("click_id").orderBy("us", "client_id", "arrived", "final", "cents")
    rows = rows.withColumn("nth", F.row_number().over(least)).where("nth = 1")
    late = F.coalesce(F.col("arrived") - F.col("us") > lateness_us, F.lit(False))
    return rows.select("client_id", "us", late.alias("late"), "click_id", "final", "cents")


def _chase(frame: pd.DataFrame, length_us: int) -> pd.DataFrame:
    """For each time of the slot before, as the first of the session open there: the first of the one open at this slot's end."""
    own = np.unique(frame.us[frame.own].to_numpy())
    start = np.unique(frame.us[~frame.own].to_numpy())
    jump = np.append(np.searchsorted(own, own + length_us, "right"), len(own))
    at, open_now = np.searchsorted(own, start + length_us, "right"), start.copy()
    while (on := at < len(own)).any():
        open_now[on] = own[at[on]]
        at[on] = jump[at[on]]
    return pd.DataFrame({"client_id": frame.client_id.iloc[0], "slot": frame.slot.iloc[0], "first": start, "then": open_now})


def entries(lined: DataFrame, links: DataFrame, scratch: Scratch, gap_us: int, length_us: int) -> DataFrame:
    """client_id, slot, entry: the first time of the session open at the start of each slot that continues the one before it.

    Within a slot all follows from its last sure start. Slots without one map the session open at their start to
    that at their end; maps of 1, 2, 4, ... slots are joined until none is left, so a chain of n such slots takes
    log2(n) rounds.
    """
    on = F.lit(length_us)
    inner = F.col("before").isNotNull() & (F.col("was_final") | (F.col("us") - F.col("before") >= gap_us))
    slots = lined.groupBy("client_id", "slot").agg(F.sort_array(F.collect_list("us")).alias("times"), F.max(F.when(inner, F.col("us"))).alias("sure_us"))
    open_slots = slots.join(links.where("continued"), ["client_id", "slot"]).withColumn("sure_us", F.coalesce("sure_us", F.when(F.col("linked").isNull(), F.get("times", F.lit(0)))))
    last = F.aggregate(F.filter("times", lambda x: x > F.col("sure_us")), F.col("sure_us"), lambda first, x: F.when(x > first + on, x).otherwise(first))
    slots = scratch.settle(open_slots.select("client_id", "slot", "times", F.when(F.col("sure_us").isNotNull(), last).alias("then")), "open")
    known = slots.where("then IS NOT NULL").select("client_id", "slot", "then")
    free = slots.where("then IS NULL").select("client_id", "slot")
    times = lambda own, shift: slots.select("client_id", (F.col("slot") + shift).alias("slot"), F.explode("times").alias("us"), F.lit(own).alias("own"))
    both = times(True, 0).union(times(False, 1)).join(free, ["client_id", "slot"], "left_semi")
    maps = scratch.settle(both.groupBy("client_id", "slot").applyInPandas(lambda f: _chase(f, length_us), "client_id long, slot long, first long, then long"), "map0")
    for k in range(63):
        if maps.isEmpty():
            break
        step = 1 << k
        ahead = lambda df: df.select("client_id", (F.col("slot") + step).alias("slot"), F.col("then").alias("first"))  # noqa: B023, E731
        known = scratch.settle(known.union(ahead(known).join(maps, ["client_id", "slot", "first"]).select("client_id", "slot", "then")), f"known{k + 1}")
        back = maps.select("client_id", (F.col("slot") + step).alias("slot"), F.col("first").alias("before"), F.col("then").alias("first"))
        maps = scratch.settle(back.join(maps, ["client_id", "slot", "first"]).select("client_id", "slot", F.col("before").alias("first"), "then"), f"map{k + 1}")
    return known.select("client_id", (F.col("slot") + 1).alias("slot"), F.col("then").alias("entry"))


def piece_before(slots: DataFrame, pieces: DataFrame) -> DataFrame:
    """client_id, slot, piece: the last piece before each of `slots` (client_id, slot), if any.

    Windows hold a client's slots of one block, or a row for each of its blocks, not its events.
    """
    block = F.floor(F.col("slot") / BLOCK)
    rows = slots.select("client_id", "slot", F.lit(False).alias("is_piece")).union(pieces.select("client_id", "slot", F.lit(True)))
    rows = rows.groupBy("client_id", block.alias("block"), "slot").agg(F.max("is_piece").alias("is_piece"), F.min("is_piece").alias("none_asks"))
    near = Window.partitionBy("client_id", "block").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("near", F.max(F.when(F.col("is_piece"), F.col("slot"))).over(near)).where("NOT none_asks")
    blocks = rows.groupBy("client_id", "block").agg(F.max(F.when(F.col("is_piece"), F.col("slot"))).alias("last"))
    far = blocks.select("client_id", "block", F.max("last").over(Window.partitionBy("client_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("far"))
    return own.join(far, ["client_id", "block"]).select("client_id", "slot", F.coalesce("near", "far").alias("piece")).where("piece IS NOT NULL")


class Automaton:
    """Takes a client's rows, or one piece's, by time: clicks, late clicks after clicks of their time, and what follows a piece."""

    gap_us, length_us = GAP, LENGTH

    def __init__(self):
        self.first = self.last = None
        self.final = False
        self.made: list[tuple] = []

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        for row in zip(*(rows.column(c).to_pylist() for c in FED)):
            self.advance(*row)
        if len(self.made) >= EMIT:
            yield self.emit()

    def advance(self, client: int, us: int, code: int, click: int, final: bool, cents: int) -> None:
        if code:
            if self.first is not None:
                if code == LATE:
                    self.late += 1
                else:
                    self.close("length" if code == TOO_LONG else "gap")
            return
        if self.first is not None:
            if self.final or us - self.last >= self.gap_us:
                self.close("gap")
            elif us - self.first > self.length_us:
                self.close("length")
        if self.first is None:
            self.client, self.session, self.first = client, click, us
            self.clicks = self.late = self.cents = 0
            self.path = hashlib.sha256(b"%d" % click)
        else:
            self.path.update(b",%d" % click)
        self.last, self.final = us, final
        self.clicks += 1
        self.cents += cents

    def close(self, by: str) -> None:
        by = "end" if self.final else by
        self.made.append((self.client, self.session, self.first, self.last, self.clicks, self.late, self.cents, by, self.path.hexdigest()))
        self.first = None

    def emit(self) -> pa.Table:
        made, self.made = self.made, []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.table([pa.array(c, pa.int64() if k < 7 else pa.string()) for k, c in enumerate(zip(*made))], names)

    def terminate(self) -> Iterator[pa.Table]:
        if self.first is not None:
            self.close("none")
        if self.made:
            yield self.emit()


def pieces_of(rows: DataFrame, scratch: Scratch, slot_us: int, gap_us: int, length_us: int) -> DataFrame:
    """The automaton's rows for clients with many events, cut where a slot's first session begins."""
    rows = scratch.settle(rows.withColumn("slot", ((F.col("us") - F.pmod("us", F.lit(slot_us))) / slot_us).cast("long")), "heavy")
    timely = rows.where("NOT late").drop("late")
    order = Window.partitionBy("client_id", "slot").orderBy("us", "click_id")

    lined = timely.withColumns({"before": F.lag("us").over(order), "was_final": F.lag("final").over(order), "after": F.lead("us").over(order)})
    edges = scratch.settle(
        lined.where("before IS NULL OR after IS NULL").groupBy("client_id", "slot").agg(
            F.min("us").alias("head"), F.max("us").alias("tail"), F.max(F.col("after").isNull() & F.col("final")).alias("tail_final")), "edges")
    ends = edges.where("NOT tail_final").select("client_id", (F.col("slot") + 1).alias("slot"), "tail")
    linked = edges.select("client_id", "slot", "head").join(ends, ["client_id", "slot"]).where(F.col("head") - F.col("tail") < gap_us).select("client_id", "slot")
    linked = scratch.settle(linked, "linked")
    links = linked.withColumn("linked", F.lit(True)).join(linked.select("client_id", (F.col("slot") - 1).alias("slot"), F.lit(True).alias("continued")), ["client_id", "slot"], "full")

    entry = entries(lined, links, scratch, gap_us, length_us)
    # what is known of a slot goes along as its first row
    notes = linked.join(entry, ["client_id", "slot"], "left").select("client_id", "slot", F.lit(-(1 << 63)).alias("us"), F.lit(0).cast("long").alias("click_id"), F.lit(True).alias("note"), "entry")
    noted = timely.unionByName(notes, allowMissingColumns=True)
    of_slot = Window.partitionBy("client_id", "slot")
    noted = noted.withColumns({"before": F.when(F.lag("note").over(order).isNull(), F.lag("us").over(order)), "was_final": F.lag("final").over(order), "linked": F.max("note").over(of_slot), "entry": F.max("entry").over(of_slot)})
    sure = F.when(F.col("before").isNull(), F.col("linked").isNull()).otherwise(F.col("was_final") | (F.col("us") - F.col("before") >= gap_us))
    marked = noted.where("note IS NULL").withColumn("sure", sure)
    dealt = marked.withColumn("starts", F.col("sure") | F.coalesce(F.col("us") > F.col("entry") + length_us, F.lit(False)))
    begun = F.max("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))
    dealt = dealt.withColumn("begun", begun).withColumn("cut", F.col("begun") & ~F.coalesce(F.lag("begun").over(order), F.lit(False)))
    dealt = dealt.select("client_id", (F.col("slot") - F.when(F.col("begun"), 0).otherwise(1)).alias("piece"), "us", F.lit(CLICK).alias("code"), "click_id", "final", "cents", "slot", "cut", "sure")
    dealt = scratch.settle(dealt, "dealt")
    pieces = dealt.where("cut").select("client_id", "slot", "us", "sure")

    late = rows.where("late").select("client_id", "slot", "us", "click_id")
    late = scratch.settle(late.join(pieces.select("client_id", "slot", F.col("us").alias("cut_us")), ["client_id", "slot"], "left"), "late")
    inside = F.coalesce(F.col("cut_us") <= F.col("us"), F.lit(False))
    asked = late.where(~inside)
    none = [F.lit(False).alias("final"), F.lit(0).cast("long").alias("cents")]
    as_late = lambda df, piece: df.select("client_id", piece, "us", F.lit(LATE).alias("code"), "click_id", *none)
    before = piece_before(asked.select("client_id", "slot").distinct(), pieces)
    last = pieces.groupBy("client_id").agg(F.max("slot").alias("slot")).withColumn("last", F.lit(True))
    cut_short = pieces.where("NOT sure").select("client_id", (F.col("slot") - 1).alias("slot"), F.col("us").alias("next_us"))
    follows = pieces.select("client_id", "slot").join(last, ["client_id", "slot"], "left_anti").join(cut_short, ["client_id", "slot"], "left")
    follows = follows.select("client_id", "slot", F.coalesce("next_us", F.lit((1 << 63) - 1)), F.when(F.col("next_us").isNull(), PAUSE).otherwise(TOO_LONG), F.lit(0).cast("long"), *none)
    return (
        dealt.select("client_id", "piece", "us", "code", "click_id", "final", "cents")
        .union(as_late(late.where(inside), F.col("slot").alias("piece")))
        .union(as_late(asked.join(before, ["client_id", "slot"]), F.col("piece")))
        .union(follows)
    )


def sessions(clicks: DataFrame, scratch: Scratch, gap_us: int = GAP, length_us: int = LENGTH, lateness_us: int = LATENESS, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """Sessions of each client's clicks (click_id, ts, arrived_at, client_id, kind, value).

    Times are compared in microseconds. A click that arrives more than lateness_us after its ts is late and
    is counted by the session that it falls into, or by none before the client's first. The others, by ts and
    click_id, continue the session unless the one before is final (`end`) or gap_us or more earlier (`gap`), or the
    session's first is more than length_us earlier (`length`). Repeated rows count once; see `events` for nulls and
    for copies that differ. An empty table, or a client with late clicks alone, gives no sessions. Other columns don't matter.

    A client with more than 1 / heavy_share of all rows (there are fewer than heavy_share of these, and the driver
    gets their ids) is dealt out by pieces, any other is one partition of the automaton's table.
    """
    rows = scratch.settle(events(clicks, lateness_us), "rows")
    counts = scratch.settle(rows.groupBy("client_id").agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("client_id").isin([r.client_id for r in counts.where(F.col("n") * heavy_share > total).collect()])
    feed = rows.where(~heavy).select("client_id", F.lit(None).cast("long").alias("piece"), "us", F.when(F.col("late"), LATE).otherwise(CLICK).alias("code"), "click_id", "final", "cents")
    feed = feed.union(pieces_of(rows.where(heavy), scratch, max(SLOT, gap_us + length_us), gap_us, length_us))
    made = F.arrow_udtf(type("Sessions", (Automaton,), {"gap_us": gap_us, "length_us": length_us}), returnType=SCHEMA)
    keyed = feed.select(F.concat_ws("/", "client_id", "piece").alias("part"), *FED)
    return made(keyed.asTable().partitionBy("part").orderBy("us", "code", "click_id"))


def op11_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of all `clicks` with the module's gap, length and lateness; see `sessions` for nulls, repeats and ties."""
    return sessions(table(spark, sf_dir, "clicks"), Scratch(spark, "op11"))


OP11_SQL = """
WITH RECURSIVE x AS (
  SELECT click_id, client_id, epoch_us(ts) AS us, coalesce(epoch_us(arrived_at) - epoch_us(ts) > 21600000000, false) AS late,
    coalesce(kind = 'error' AND value >= 60 AND NOT isnan(value), false) AS final,
    CASE WHEN value IS NULL OR isnan(value) THEN 0 ELSE CAST(floor(value * 100 + 0.5) AS BIGINT) END AS cents
  FROM clicks WHERE click_id IS NOT NULL AND ts IS NOT NULL AND client_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY ts, client_id, arrived_at NULLS FIRST, kind NULLS FIRST, value NULLS FIRST) = 1
), t AS (
  SELECT *, row_number() OVER w AS i, coalesce(lag(final) OVER w OR us - lag(us) OVER w >= 600000000, true) AS sure
  FROM x WHERE NOT late WINDOW w AS (PARTITION BY client_id ORDER BY us, click_id)
), n AS (
  SELECT *, 1 + count(*) OVER (PARTITION BY client_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 2400000000 FOLLOWING) AS far,
    coalesce(min(CASE WHEN sure THEN i END) OVER (PARTITION BY client_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
      1 + count(*) OVER (PARTITION BY client_id)) AS next_sure
  FROM t
), r AS (
  SELECT client_id, i FROM n WHERE sure
  UNION SELECT n.client_id, n.far FROM r JOIN n ON r.client_id = n.client_id AND r.i = n.i WHERE n.far < n.next_sure
), g AS (
  SELECT n.*, count(r.i) OVER (PARTITION BY n.client_id ORDER BY n.i) AS k FROM n LEFT JOIN r ON r.client_id = n.client_id AND r.i = n.i
), a AS (
  SELECT client_id, k, arg_min(click_id, i) AS session_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_clicks,
    CAST(sum(cents) AS BIGINT) AS value_cents, arg_max(final, i) AS final, sha256(string_agg(CAST(click_id AS VARCHAR), ',' ORDER BY i)) AS path_sha256
  FROM g GROUP BY client_id, k
), b AS (
  SELECT *, lead(start_us) OVER (PARTITION BY client_id ORDER BY k) AS then_us FROM a
), l AS (
  SELECT b.client_id, b.k, count(*) AS n_late FROM b JOIN x ON x.late AND x.client_id = b.client_id AND x.us >= b.start_us
    AND (b.then_us IS NULL OR x.us < b.then_us) GROUP BY b.client_id, b.k
)
SELECT b.client_id, session_id, start_us, end_us, n_clicks, coalesce(n_late, 0) AS n_late, value_cents,
  CASE WHEN final THEN 'end' WHEN then_us IS NULL THEN 'none' WHEN then_us - end_us >= 600000000 THEN 'gap' ELSE 'length' END AS closed_by, path_sha256
FROM b LEFT JOIN l ON l.client_id = b.client_id AND l.k = b.k
"""
