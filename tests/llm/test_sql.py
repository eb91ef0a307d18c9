"""The registered corpus queries on the smallest public tables: against their SQL twins, and what the contracts fix for all."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from snapweave.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(frame):
    return sorted(map(tuple, frame[sorted(frame)].values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got) == sorted(want) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_a_row_for_each_row(spark, name):
    table, key = ("pages", "page_id") if name == "op6_extract" else ("documents", "doc_id")
    ids = lambda df: sorted(r[0] for r in df.select(key).collect())
    assert ids(queries.QUERIES[name](spark, SF)) == ids(spark.read.parquet(f"{SF}/{table}.parquet"))


def test_shards_of_the_query_are_even_and_whole(spark):
    out = queries.op5_resharding(spark, SF)
    held = [r[0] for r in out.groupBy("shard").agg(F.sum("size")).collect()]
    largest = out.agg(F.max("size")).first()[0]
    assert len(held) == 16 and max(held) - min(held) <= 2 * largest
    spread = out.groupBy("text_crc32", "size").agg(F.countDistinct("shard").alias("n"), F.sum("size").alias("all")).filter("n > 1")
    assert spread.filter(F.col("all") <= sum(held) / 16).isEmpty()
