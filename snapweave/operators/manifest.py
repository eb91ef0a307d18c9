"""Manifests: validity, references, and snapshot sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def violations(entries: DataFrame, keyed: bool = True) -> DataFrame:
    """rule, path: unsafe paths, paths given twice, paths that differ in spelling alone, and entries below another entry."""
    bad = entries.select(paths.violation(F.col("path")).alias("rule"), "path").filter("rule is not null").distinct()
    twice = entries.groupBy("path").count().filter("count > 1").select(F.lit("duplicate-path").alias("rule"), "path")
    one = entries.select("path").distinct()
    key = paths.portable_key(F.col("path")) if keyed else F.lower("path")
    spelled = one.withColumn("k", key)
    shared = spelled.groupBy("k").agg(F.count("*").alias("n"), F.min("path").alias("first")).filter("n > 1")
    alias = spelled.join(shared, "k").filter("path <> first").select(F.lit("portable-alias").alias("rule"), "path")
    up = one.select("path", F.explode(paths.ancestors(F.col("path"))).alias("at"))
    below = up.join(one.select(F.col("path").alias("at")), "at", "left_semi").select(F.lit("managed-parent").alias("rule"), "path").distinct()
    return bad.unionByName(twice).unionByName(alias).unionByName(below)


def distinct_blobs(entries: DataFrame) -> DataFrame:
    """blob_oid and the first path (in byte order) that refers to it."""
    return entries.filter("kind = 'regular'").groupBy(F.col("oid").alias("blob_oid")).agg(F.min("path").alias("first_path"))


def snapshot_bytes(edges: DataFrame, sizes: DataFrame, quota: int) -> DataFrame:
    """tree_id, bytes, over_quota. Every path counts, so that a blob used twice counts twice."""
    return edges.join(sizes, "blob_id").groupBy("tree_id").agg(F.sum("length").alias("bytes")).withColumn("over_quota", F.col("bytes") > quota)


def upgrade_is_total(sources: DataFrame, mapping: DataFrame) -> DataFrame:
    """problem, oid: roots without a replacement, replacements without a root, and roots replaced twice. Empty for a total map."""
    missing = sources.join(mapping, sources.oid == mapping.old_oid, "left_anti").select(F.lit("missing").alias("problem"), "oid")
    extra = mapping.join(sources, sources.oid == mapping.old_oid, "left_anti").select(F.lit("extra").alias("problem"), F.col("old_oid").alias("oid"))
    twice = mapping.groupBy("old_oid").count().filter("count > 1").select(F.lit("ambiguous").alias("problem"), F.col("old_oid").alias("oid"))
    return missing.distinct().unionByName(extra.distinct()).unionByName(twice)


def import_preflight(edges: DataFrame, sizes: DataFrame, quota: int, most_entries: int = 100_000) -> DataFrame:
    """tree_id, rule by which trees (edges: tree_id, blob_id; sizes: blob_id, length) must not be imported: a blob that the source lacks, a
    snapshot above the quota, or too many entries. Nothing is imported unless this is empty."""
    met = edges.join(sizes.withColumn("there", F.lit(True)), "blob_id", "left").groupBy("tree_id").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.count_if(F.col("there").isNull()).alias("lost"))
    rules = F.array(F.when(F.col("lost") > 0, "missing-blob"), F.when(F.col("bytes") > quota, "over-quota"), F.when(F.col("n") > most_entries, "too-many-entries"))
    return met.select("tree_id", F.explode(rules).alias("rule")).filter("rule is not null")


def new_blobs(snapshot: DataFrame, store: DataFrame) -> DataFrame:
    """What publishing a snapshot must write: one row for each oid that the store lacks."""
    return snapshot.filter("kind = 'regular'").select("oid").distinct().join(store, "oid", "left_anti")
