"""Reading workspaces and session logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.tables import written
from . import listing

MAX_FILE_BYTES = 50 << 20
SESSION_LOG = "type string, id string, parentId string, message struct<role:string>"


def scan(spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES, managed: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries (path, kind, oid, target, byte_length), problems (path, kind) and excluded (path, kind) of the tree under root.

    The tree is walked a level at a time, each level as one table. managed takes (path, kind) and gives (path, managed): what it
    excludes is neither read nor entered, so of an excluded folder only its own row is kept. Unsafe paths, second spellings of a
    path, other devices, special files, hard links, too large and unreadable files are problems, never entries.
    """
    level, every = spark.createDataFrame([("",)], "path string"), None
    wide = listing.width(spark)
    for _ in range(paths.MAX_COMPONENTS + 1):
        found = written(listing.children(level.repartition(wide, "path"), root), "listing")
        found = found.withColumn("managed", F.lit(True)) if managed is None else found.join(managed(found.select("path", "kind")), "path", "left")
        sound = F.when(F.col("kind").isin("unreadable", "invalid-name"), F.col("kind")).when(paths.violation(F.col("path")).isNotNull(), "invalid-path").when(F.col("elsewhere"), "cross-device")
        first = F.col("managed") & F.col("why").isNull()
        key = F.when(first, paths.portable_key(F.col("path"))).otherwise(F.col("path"))
        rank = F.row_number().over(Window.partitionBy("key", first).orderBy("path"))
        regular = F.col("kind") == "regular"
        why = F.coalesce("why", F.when(F.col("rank") > 1, "portable-collision").when(F.col("kind") == "special", "unsupported").when(regular & (F.col("links") > 1), "hardlink").when(regular & (F.col("byte_length") > max_bytes), "too-large"))
        judged = written(found.withColumn("why", sound).withColumn("key", key).withColumn("rank", rank).withColumn("why", F.when(F.col("managed"), why)).drop("key", "rank", "links", "elsewhere"), "level")
        every = judged if every is None else every.unionByName(judged)
        level = judged.filter("managed and why is null and kind = 'directory'").select("path")
        if level.isEmpty():
            break
    good = every.filter("managed and why is null")
    files = good.filter("kind = 'regular'").select("path", "byte_length")
    read = written(files.join(listing.digests(files.repartition(wide, "path"), root), "path"), "digests")
    entries = read.filter("oid is not null").select("path", F.lit("regular").alias("kind"), "oid", F.lit(None).cast("string").alias("target"), "byte_length")
    links = good.filter("kind = 'symlink'").select("path", "kind", F.lit(None).cast("string").alias("oid"), "target", F.octet_length("target").cast("long").alias("byte_length"))
    lost = read.filter("oid is null").select("path", F.lit("read-failed").alias("kind"))
    problems = every.filter("managed and why is not null").select("path", F.col("why").alias("kind")).unionByName(lost)
    return entries.unionByName(links), problems, every.filter("not managed").select("path", "kind")


def summarize(problems: DataFrame, examples: int = 3) -> DataFrame:
    """One row: how many problems, the first few by path, and how many remain."""
    first = problems.orderBy("path").limit(examples).agg(F.array_sort(F.collect_list(F.struct("path", "kind"))).alias("examples"))
    return problems.agg(F.count("*").alias("problems")).join(first, F.lit(True)).withColumn("more", F.greatest(F.col("problems") - examples, F.lit(0)))


def session_log(spark: SparkSession, path: str) -> DataFrame:
    """entry_id, parent_id, type, role, ord of JSON lines; a malformed line fails the read. ord is the line's place in its file."""
    rows = spark.read.schema(SESSION_LOG).option("mode", "FAILFAST").json(path)
    at = F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1
    rows = rows.select("id", "parentId", "type", "message", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    role = F.when(F.col("type") == "message", F.col("message.role"))
    return rows.select("file", F.col("id").alias("entry_id"), F.col("parentId").alias("parent_id"), "type", role.alias("role"), at.alias("ord"))
