"""A corpus pipeline: five stages of the snapweave.llm operators, from the raw documents to shards.

Each stage reads what its predecessor kept and returns the columns of documents; the last adds old_shard and shard (in place of columns of
these names).

1. Language ID drops texts without letters, and long ones in no language that was learned; null and empty texts so go here. If there is
   no label to learn from, all documents stay.
2. Of each group of near-duplicates the document with the smallest doc_id stays (nulls last; rows that agree in all but other columns:
   one of them), a document without words being near every other such one.
3. Documents go of which a twentieth of the words or more lies in passages of the benchmark. An empty benchmark drops nothing.
4. Documents are repeated, cut or left out so that sources meet their targets; a null source is one of its own; ties at a cut share
   what is left there.
5. Every document gets a shard; equal texts lie together, unless they exceed a shard.

Null doc_ids and repeated rows are rows like others. Texts are taken whole, of any length. Columns with clashing names are carried inside
one column. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snapweave.llm import decontaminate, langid, mixing, resharding, simhash
from snapweave.llm.common import cut, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resharding.assign(docs)


STAGES = [("language ID", language), ("near-duplicates", near_duplicates), ("decontamination", benchmark), ("mixing", mix), ("sharding", shards)]

#: Language ID and SimHash can't be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"stage{i + 1}")
    return docs
