"""Every registered query with a SQL twin gives the rows that DuckDB gives, on the smallest public tables."""

import os

import duckdb
import pandas as pd
import pytest

from snapweave.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    v = v.item() if hasattr(v, "item") else v
    return float(v) if isinstance(v, int | float) else v


def norm(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLES:
        assert len(got) > 0
        return
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert {r.action: r["count"] for r in e.entry(spark).groupBy("action").count().collect()} == {"created": 12, "deleted": 11, "modified": 13}
    assert set(e.oracle_sql()) <= set(e.queries())
