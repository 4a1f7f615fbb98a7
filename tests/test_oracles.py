"""Every query against its SQL on DuckDB."""

import math
import pathlib

import duckdb
import pandas as pd
import pytest

from pelorus import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()
ORACLES = catalogue.oracle_sql()


def rows(frame):
    names = sorted(frame.columns)
    out = []
    for r in frame[names].astype(object).itertuples(index=False):
        out.append(tuple(None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r))
    return names, sorted(out, key=lambda t: tuple((v is None, str(v)) for v in t))


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6))


@pytest.fixture(scope="module")
def db(data):
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{pathlib.Path(data) / t}.parquet')")
    return made


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, data, db, name):
    got, want = rows(catalogue.queries()[name](spark, data).toPandas()), rows(db.execute(ORACLES[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert sum(not all(map(same, a, b)) for a, b in zip(got[1], want[1])) == 0
