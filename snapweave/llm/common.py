"""What the corpus operators share: table access, the shared folder, lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"

BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir, as a URI. Where that setting is unset, a temporary folder serves a local master; a
    cluster's machines would not see it, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='snapweave-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again, so that nothing upstream is ever recomputed.

    While it is written, rows go to Python in batches of BATCH_ROWS at most, since each may hold a whole text.
    """
    spark = df.sparkSession
    path, old = shared_dir(spark, tag), spark.conf.get(BATCHES, None)
    spark.conf.set(BATCHES, str(min(BATCH_ROWS, int(old or BATCH_ROWS))))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(BATCHES) if old is None else spark.conf.set(BATCHES, old)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that cut() wrote and no pending result reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one, ``row``, so that no name of theirs meets a name of an operator's."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def word_array(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[\\x20\\x09-\\x0D]+"))
