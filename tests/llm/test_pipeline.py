"""The stages of the pipeline against a plain version of each, every one on what its predecessor kept."""

import collections
import re
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from snapweave.llm import mixing, resharding, simhash
from test_corpus import SCHEMA, rows  # noqa: F401  the same odd rows


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, " ".join(f"bench{k}" for k in range(15)))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, lake):
    docs, seen = spark.read.parquet(f"{lake}/documents.parquet"), []
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, lake)
        assert out.columns == columns if i < 4 else set(columns) < {*out.columns, *columns}
        out = spark.createDataFrame(out.collect(), out.schema)
        seen.append((docs, out))
        docs = out
    (raw, known), (_, single), (_, clean), (_, mixed), (_, sharded) = seen
    ids = lambda df: collections.Counter(r.doc_id for r in df.select("doc_id").collect())
    assert collections.Counter(r.doc_id for r in raw.collect() if any(c.isalpha() for c in r.text or "")) - ids(known) == {64: 1}  # of several scripts
    groups = simhash.near_duplicates(known).select("component_id").distinct().count()
    assert single.count() == groups
    assert 88 in ids(single) and 88 not in ids(clean) and ids(single) - ids(clean) == {88: 1}
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(clean).collect()}
    assert ids(mixed) == {i: -(-t // n) for i, (t, n) in taken.items() if t}
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixed.collect()) == sum(t for t, _ in taken.values())
    assert ids(sharded) == ids(mixed)
    size, largest = collections.Counter(), collections.Counter()
    for r in sharded.collect():
        n = len(r.text.encode()) + 1
        size[r.shard] += n
        largest[r.shard] = max(largest[r.shard], n)
    share = sum(size.values()) / 16
    assert set(size) <= set(range(16)) and sum(size.values()) == sum(len(r.text.encode()) + 1 for r in mixed.collect())
    rest = [size[k] for k in range(16) if largest[k] <= share]  # a text longer than a shard's share lies where it must
    assert max(rest) - min(rest) <= share


def test_ties_of_the_stages(spark, lake):
    """Rows that agree in everything: one of them stays, the same in every run; equal texts lie in one shard."""
    docs = spark.read.parquet(f"{lake}/documents.parquet")
    twice = docs.unionByName(docs).unionByName(docs.filter("doc_id = 7"))
    one, again = (simhash.deduplicate(x).select("doc_id", "text").collect() for x in (twice, twice.repartition(7)))
    assert sorted(one, key=repr) == sorted(again, key=repr) and len(one) == simhash.deduplicate(docs).count()
    shards = collections.defaultdict(set)
    for r in resharding.assign(twice).collect():
        shards[r.text].add(r.shard)
    whole = sum(len((r.text or "").encode()) + 1 for r in twice.collect())
    assert all(len(x) == 1 for t, x in shards.items() if 2 * len((t or "").encode()) < whole / 16)


def test_run_and_empty(spark, lake, tmp_path):
    out = corpus_pipeline.run(spark, lake)
    assert out.count() > 0 and {"old_shard", "shard"} <= set(out.columns)
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, lake).count() == 0
