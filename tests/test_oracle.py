"""Layer 1: every query with a SQL oracle agrees with DuckDB (sf0.001)."""

import os

import pytest

from paths import SF_SMALL

import __spark_entry__ as E
from tools.check_oracle import TABLES, digest

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_registered():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 80


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["Source", "Left", "n", "share"]
    assert len(rows) > 0


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(dcols, drows)[0]
