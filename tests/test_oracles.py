"""Every registered query against its oracle SQL, on the smallest data."""

import math

import duckdb
import pytest

from quillon.plans import catalog as plans
from quillon.session import TABLES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, sf, duck):
    df = plans.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    relation = duck.execute(plans.ORACLES[name])
    named = [d[0] for d in relation.description]
    assert sorted(named) == columns
    want = sorted(tuple(plain(r[named.index(c)]) for c in columns) for r in relation.fetchall())
    assert got == want
