"""Every query of the engine against its SQL on the smallest data."""

from __future__ import annotations

import math

import duckdb
import pytest

from gridloom.plans.registry import ORACLES, QUERIES
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(plain(r[i])) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        columns = [c[0] for c in want.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows(df.columns, got) == rows(columns, want.fetchall())
    else:
        assert got


def test_roundtrip_keeps_every_grid(spark):
    assert QUERIES["csv_roundtrip"](spark, DATA).where("not same").count() == 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
