"""Sessions, fewest sequences and periodic runs against brute force, with the odd cases of each."""

import collections
import datetime
import hashlib
import math
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from pelorus.llm import linear_grouping, packing, periodic_runs, queries, sessions
from pelorus.llm.common import Scratch

M = sessions.MINUTE
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, piece string"
ODD_TEXTS = [(1, "a b c"), (2, None), (3, ""), (4, " \t\n"), (5, "x " * 3000), (5, "x " * 3000), (None, "y y y y y y z"), (7, "é " * 9 + "日本 " * 7), (8, "ab " * 20 + "cd ef " * 20)]


# 11 sessions


def brute_sessions(rows, gap=10 * M, length=40 * M, lateness=360 * M):
    """rows: (click_id, us, arrived us, client, kind, value)."""
    by, out = collections.defaultdict(dict), []
    for r in rows:
        if None not in (r[0], r[1], r[3]):
            by[r[3]][r[0]] = r
    for client, own in by.items():
        is_late = lambda r: r[2] is not None and r[2] - r[1] > lateness
        late, found = [r[1] for r in own.values() if is_late(r)], []
        for i, us, _, _, kind, value in sorted((r for r in own.values() if not is_late(r)), key=lambda r: (r[1], r[0])):
            s = found[-1] if found else None
            why = None if s is None else "end" if s["final"] else "gap" if us - s["end"] >= gap else "length" if us - s["start"] > length else None
            if s is None or why:
                if s:
                    s["by"] = why
                s = {"start": us, "ids": [], "cents": 0, "by": None}
                found.append(s)
            s["end"], s["final"] = us, kind == "error" and value is not None and value >= 60
            s["ids"].append(i)
            s["cents"] += 0 if value is None or math.isnan(value) else math.floor(100 * value + 0.5)
        for k, s in enumerate(found):
            to = found[k + 1]["start"] if k + 1 < len(found) else math.inf
            by_ = s["by"] or ("end" if s["final"] else "none")
            out.append((client, s["ids"][0], s["start"], s["end"], len(s["ids"]), sum(s["start"] <= x < to for x in late), s["cents"], by_, hashlib.sha256(",".join(map(str, s["ids"])).encode()).hexdigest()))
    return sorted(out)


def clicks_of(spark, rows):
    at = lambda us: None if us is None else datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=us)
    return spark.createDataFrame([(i, at(us), at(arrived), client, kind, value, "x") for i, us, arrived, client, kind, value in rows], CLICKS)


def drawn_clicks(r, n, clients, mean_us):
    rows, now = [], collections.Counter()
    for i in range(n):
        c = r.choice(clients)
        now[c] += r.choice([0, 0, 1, int(r.expovariate(1 / mean_us)), r.choice([10 * M, 10 * M - 1, 40 * M, 41 * M])] if r.random() < 0.1 else [int(r.expovariate(1 / mean_us))])
        us = 1_704_067_200_000_000 + now[c]
        late = r.random() < 0.1
        rows.append((i, us, r.choice([None, us, us + 360 * M]) if not late else us + 360 * M + 1, c, r.choice(["error", "view", None]) if r.random() < 0.1 else "view", r.choice([None, 59.99, 60.0, 61.0, -3.456, math.nan])))
    r.shuffle(rows)
    return rows + r.sample(rows, n // 10)


@pytest.mark.parametrize("mean_minutes, share", [(3, 512), (0.5, 2), (9, 1)])
def test_sessions_are_brute_force(spark, mean_minutes, share):
    """One client has most rows; few final clicks, so that hours without a sure start follow each other; shares that cut all, some or no clients."""
    r = random.Random(mean_minutes)
    rows = drawn_clicks(r, 4000, [7] * 6 + [1, 2, None], mean_minutes * M)
    got = sessions.sessions(clicks_of(spark, rows).repartition(5), Scratch(spark, "t11"), heavy_share=share)
    assert sorted(map(tuple, got.collect())) == brute_sessions(rows)


def test_a_long_chain_of_hours_without_pause(spark):
    rows = [(i, 1_704_067_200_000_000 + i * 7 * M, None, 5, "view", 1.0) for i in range(3000)]
    rows += [(5000 + i, r[1], r[1] + 361 * M, 5, "view", 1.0) for i, r in enumerate(rows[::50])]
    rows += [(9000, 1_704_067_200_000_000 - 5 * M, 1_704_067_200_000_000 + 400 * M, 5, "view", 1.0), (9001, 1_804_067_200_000_000, 1_904_067_200_000_000, 5, "view", 1.0)]
    got = sorted(map(tuple, sessions.sessions(clicks_of(spark, rows), Scratch(spark, "t11c")).collect()))
    assert got == brute_sessions(rows) and len(got) == 500 and got[-1][5] == 1


def test_sessions_odd(spark):
    assert sessions.sessions(clicks_of(spark, []), Scratch(spark, "t11e")).count() == 0
    t = 1_704_067_200_000_000
    rows = [(1, t, None, 1, None, None), (1, t, None, 1, None, None), (None, t, t, 1, "view", 1.0), (2, None, t, 1, "view", 1.0), (3, t, t, None, "view", 1.0), (4, t, t + 400 * M, 2, "view", 1.0), (5, -t, -t, 3, "error", 60.0), (6, -t, -t, 3, "error", 60.0)]
    got = sorted(map(tuple, sessions.sessions(clicks_of(spark, rows), Scratch(spark, "t11o")).collect()))
    assert got == brute_sessions(rows) and [g[0] for g in got] == [1, 3, 3]


def test_sessions_do_not_depend_on_the_zone(spark):
    rows = drawn_clicks(random.Random(3), 300, [1, 2], 3 * M)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = sessions.sessions(clicks_of(spark, rows), Scratch(spark, "t11z")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert sorted(map(tuple, got)) == brute_sessions(rows)


def test_op11_sql(spark, data):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW clicks AS SELECT * FROM read_parquet('{data}/clicks.parquet')")
    names = sessions.SCHEMA.replace(" long", "").replace(" string", "")
    want = db.execute(f"SELECT {names} FROM ({queries.ORACLE_SQL['op11_gap_sessions']})").fetchall()
    assert sorted(map(tuple, queries.QUERIES["op11_gap_sessions"](spark, data).collect())) == sorted(want)


# 12 fewest sequences


def check_plan(runs, counts, window):
    ranks, held = collections.defaultdict(list), collections.defaultdict(list)
    for r in runs:
        for i in range(r.count):
            ranks[r.length].append(r.rank + i)
            held[r.sequence + i].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items() if v}
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    return len(held)


def test_plan_is_as_good_as_best_fit_decreasing():
    r = random.Random(12)
    assert linear_grouping.plan({}) == []
    for n, draw in ((3000, lambda: int(r.lognormvariate(6.5, 0.9))), (3000, lambda: r.randrange(1, 2049)), (2000, lambda: r.choice([700, 683, 1025, 512])), (5, lambda: 2048), (400, lambda: r.randrange(600, 2049)), (50, lambda: 1)):
        counts = dict(collections.Counter(min(2048, max(1, draw())) for _ in range(n)))
        _, best = packing.pack_pieces([k for k, v in counts.items() for _ in range(v)], 2048)
        assert check_plan(linear_grouping.plan(counts), counts, 2048) <= best * 1.01 + 1


def test_plan_does_not_grow_with_counts():
    r = random.Random(13)
    counts = dict(collections.Counter(r.randrange(1, 2049) for _ in range(5000)))
    small, large = (linear_grouping.plan({k: v * m for k, v in counts.items()}) for m in (1, 10**9))
    assert len(large) < 4 * len(small) and sum(x.length * x.count for x in large) == 10**9 * sum(k * v for k, v in counts.items())
    assert max(x.sequence + x.count for x in large) <= 1.01 * sum(k * v for k, v in counts.items()) * 10**9 / 2048


def test_linear_program_is_optimal():
    """Three sizes of which exactly three fill a window: no packing of halves does better than the fractional one."""
    got = linear_grouping.configurations([50, 30, 20], [100, 100, 100], 100)
    assert math.isclose(sum(t for t, _ in got), 100)
    assert all(sum([50, 30, 20][g] for g in c) <= 100 for _, c in got)
    assert linear_grouping.best_configuration(np.array([0.5, 0.34, 0.2]), np.array([50, 30, 20]), 100)[0] == pytest.approx(1.04)


def check_op12(df, window=2048):
    enc = packing.byte_encoder(packing._default_path()).library
    rows = linear_grouping.pack_fewest(df, Scratch(df.sparkSession, "t12"), window).collect()
    want, of, held = collections.Counter(), collections.defaultdict(list), collections.defaultdict(list)
    for r in df.collect():
        ids = np.array([*enc.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % window or window
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), window)], range(first, len(ids) + 1, window))):
            want[r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    for r in rows:
        of[r.doc_id].append(r)
        held[r.sequence_id].append((r.offset, r.length))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    return len(held), -(-sum(r.length for r in rows) // window)


def test_op12(spark, data):
    made, least = check_op12(spark.read.parquet(f"{data}/documents.parquet"))
    assert made <= least * 1.02 + 1
    odd = spark.createDataFrame([(*r, "p", 3) for r in ODD_TEXTS], "doc_id long, text string, part string, nth long").repartition(3)
    check_op12(odd, 64)
    assert linear_grouping.pack_fewest(odd.limit(0), Scratch(spark, "t12e")).count() == 0


# 13 periodic runs


def brute_runs(doc_id, words):
    """Every period of every document, by the definition; the smallest period of a stretch is the first that gives it."""
    n, runs = len(words), {}
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            size = e - s + q
            if e > s and size >= max(6, 4 * q):
                runs.setdefault((s, size), q)
            s = max(e, s) + 1
    runs = sorted(((s, size, q) for (s, size), q in runs.items()), key=lambda r: (r[0], r[2]))
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = (None,) * 4
    if runs:
        top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (*top, 1000 * top[1] // top[2])
    said = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (doc_id, len(runs), *best, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest())


def drawn_words(r):
    out = []
    for _ in range(r.randrange(8)):
        base = [r.choice([b"a", b"b", b"c", b"dd"][: r.randrange(1, 5)]) for _ in range(r.randrange(1, 8))]
        m = r.randrange(1, 40)
        out += (base * m)[:m] + [r.choice([b"a", b"x"]) for _ in range(r.randrange(3))]
    return out


@pytest.mark.parametrize("levels, pairs", [(16, 1 << 20), (2, 8)])
def test_runs_are_brute_force(monkeypatch, levels, pairs):
    monkeypatch.setattr(periodic_runs, "LEVELS", levels)
    monkeypatch.setattr(periodic_runs, "SLICE_PAIRS", pairs)
    r, some = random.Random(levels), 0
    for _ in range(150):
        docs = [drawn_words(r) for _ in range(r.randrange(1, 9))]
        want = [brute_runs(i, w) for i, w in enumerate(docs)]
        assert periodic_runs.rows_of(list(range(len(docs))), docs) == want
        some += sum(w[1] for w in want)
    assert some > 300


def test_other_least_runs_are_found():
    assert periodic_runs.least_overlap() == 5 and periodic_runs.least_overlap(2, 2) == 1 and periodic_runs.least_overlap(9, 3) == 6
    assert periodic_runs.rows_of([1], [[b"a", b"a", b"b", b"c", b"b", b"c"]], 2, 2)[0][1] == 2


def test_long_runs_take_time_in_proportion():
    n = 100_000
    for words, period in (([b"a"] * n, 1), ([b"%d" % (i % (n // 5)) for i in range(n)], n // 5)):
        assert periodic_runs.rows_of([1], [words])[0][1:5] == (1, 0, n, period)


def test_op13_is_brute_force(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    short = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 3000]
    rows = short + ODD_TEXTS + [(20_000 + i, b" ".join(drawn_words(random.Random(i))).decode()) for i in range(200)]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_runs int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    want = [brute_runs(i, periodic_runs.with_period(i, (t or "").encode().split())) for i, t in rows]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_documents_are_given_a_period():
    words = [b"%d" % i for i in range(50)]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    for i in ids:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % 50
        p = 1 + (50 - a) // (3 + g % 8)
        assert periodic_runs.with_period(i, words) == [words[a + (k - a) % p] if k >= a else words[k] for k in range(50)]
    assert periodic_runs.with_period(ids[0] + 1 if ids[0] + 1 not in ids else None, words) is words and periodic_runs.with_period(ids[0], []) == []
