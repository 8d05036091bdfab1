"""Every query of the library proper against its SQL, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from adweave.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or (not isinstance(v, str) and pd.isna(v)):
            return None
        if hasattr(v, "isoformat"):
            return v.isoformat()[:10]
        return round(float(v), 6) if isinstance(v, float) or type(v).__name__.startswith("float") else v.item() if hasattr(v, "item") else v

    rows = [tuple(value(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)]
    return sorted(rows, key=str)


def same(a, b) -> bool:
    return a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DIR).toPandas()
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    assert all(same(x, y) for r, s in zip(a, b) for x, y in zip(r, s))


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
