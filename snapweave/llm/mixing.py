"""Mixing sources to target weights.

Every document has a hash-random key. Within each source the documents are ordered by that key, in ranges of its leading hex
digits: sums of the ranges of two digits find the range in which the source's budget ends, sums of its parts by two more digits
the part, and so on until few rows are left; there a window does the rest. A source's budget is spent along that order: whole epochs
first, then the documents up to the exact word at which the budget ends. Targets come from sums over the sources, which are
rows like others, of any number.

A null text has size 0 and is never taken from; a null source is a source of its own, last in order. Equal keys are
ordered by doc_id and size; rows that agree in these (repeated rows) at the cut share what is left there equally. An empty table, or one without words, gives
targets of 0. Only doc_id, source and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, whole_row

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Rows of a source that one task may sort at the cut; ranges are divided until they have no more.
RANGE_ROWS = 1000
#: Hex digits by which a range is divided, and most digits used.
DIGITS, MOST_DIGITS = 2, 32
#: Sources up to which the row that each has is broadcast; beyond, they are joined like other tables.
BROADCAST_SOURCES = 20_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def weighed(sources: DataFrame, n: int, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (source, all different) with weight: weights in turn by code point, null last. Rows are numbered range by range."""
    order = F.col("source").asc_nulls_last()
    ranged = cut(sources.repartitionByRange(max(1, n // 100_000), order).withColumn("range", F.spark_partition_id()), "sources")
    starts, at = [], 0
    for r, k in sorted(tuple(x) for x in ranged.groupBy("range").count().collect()):
        starts.append((r, at))
        at += k
    begin = F.broadcast(sources.sparkSession.createDataFrame(starts, "range int, begin long"))
    number = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1 + F.col("begin")
    return ranged.join(begin, "range").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int"))).drop("range", "begin")


def targets(sources: DataFrame, n: int, share: float = SHARE) -> DataFrame:
    """sources (source, source_size) with weight and target. A source whose weighted part is above MOST times its size stops
    there, and the rest is shared anew: the rate of a weight grows until no more sources stop."""
    rows = cut(weighed(sources, n), "weights")
    most, rate = MOST * F.col("source_size"), 0.0
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    stops, before = F.lit(False), -1
    while True:
        held, stopped, open_ = rows.agg(F.coalesce(F.sum(F.when(stops, most)), F.lit(0)), F.count(F.when(stops, 1)), F.coalesce(F.sum(F.when(~stops, F.col("weight"))), F.lit(0))).first()
        if stopped == before:
            break
        rate = (share * total - held) / open_ if open_ else 0.0
        before = stopped
        stops = stops | (F.col("weight") * F.lit(rate) > most)
    return rows.withColumn("target", F.when(stops, most.cast("double")).otherwise(F.col("weight") * F.lit(rate)))


def sort_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def cuts(sized: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """By source: source_size, target, epochs, and where the last epoch is cut (c_key, c_id, c_size; c_left words of each row there).

    sized has source, doc_id, size and key. Only sums over all sources, and the size of the largest range, reach the driver.
    """
    sources = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sums")
    count = sources.count()
    few = F.broadcast if count <= BROADCAST_SOURCES else lambda x: x
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    plan = targets(sources, count).withColumn("epochs", epochs).withColumn("left", F.when(F.col("source_size") > 0, budget - F.col("epochs") * F.col("source_size")).otherwise(F.lit(0)))
    plan = cut(plan.withColumnRenamed("source", "s"), "plan")
    at = cut(plan.filter("left > 0").select("s", F.lit("").alias("r"), "left", "n"), "range")
    digits, largest, before = 0, at.agg(F.max("n")).first()[0] or 0, None
    along = Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.col("source").eqNullSafe(F.col("s")) & F.col("key").startswith(F.col("r"))
    while largest > range_rows and largest != before and digits < MOST_DIGITS:
        digits += DIGITS
        within = sized.select("source", "key", "size").join(few(at.drop("n")), inside)
        sums = within.groupBy("s", "left", F.substring("key", 1, digits).alias("r")).agg(F.sum("size").alias("sum"), F.count("*").alias("n"))
        starts = sums.withColumn("start", F.coalesce(F.sum("sum").over(along), F.lit(0))).filter("start < left and left <= start + sum")
        at = cut(starts.select("s", "r", (F.col("left") - F.col("start")).alias("left"), "n"), "range")
        before, largest = largest, at.agg(F.max("n")).first()[0] or 0
    rows = sized.join(few(at.drop("n")), inside)
    ties = rows.groupBy("s", "left", "key", "doc_id", "size").agg(F.count("*").alias("n"))
    ordered = Window.partitionBy("s").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    ends = ties.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("size")).over(ordered), F.lit(0)))
    ends = ends.filter("before < left and left <= before + n * size")
    ends = ends.select(F.col("s").alias("e"), F.col("key").alias("c_key"), F.col("doc_id").alias("c_id"), F.col("size").alias("c_size"), F.expr("(left - before) div n").alias("c_left"))
    out = plan.select("s", "source_size", "target", "epochs").join(ends, F.col("s").eqNullSafe(F.col("e")), "left").drop("e")
    return few(cut(out, "cuts"))


def with_taken(rows: DataFrame, cut_at: DataFrame) -> DataFrame:
    """rows (source, doc_id, size, key) with source_size, target and taken. One row a source is joined; rows aren't moved."""
    both = rows.join(cut_at, F.col("source").eqNullSafe(F.col("s")))
    # numbers compare alike in both; a null doc_id comes first
    mine = F.struct(F.col("key"), F.col("doc_id"), F.col("size"))
    there = F.struct(F.col("c_key").alias("key"), F.col("c_id").alias("doc_id"), F.col("c_size").alias("size"))
    last = F.when(F.col("c_key").isNull(), F.lit(0)).when(mine < there, F.col("size")).when(mine == there, F.col("c_left")).otherwise(F.lit(0))
    return both.withColumn("taken", (F.col("epochs") * F.col("size") + last).cast("long"))


def mix(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken."""
    sized = cut(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), sort_key(F.col("doc_id")).alias("key")), "sized")
    return with_taken(sized, cuts(sized, range_rows)).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mix itself: a row for each time a document is taken; where the budget ends inside a document, its words up to there.

    n_chars, where it is a column of docs, follows the text. The texts are not shuffled.
    """
    names = docs.columns
    limit = "_words" + "_" * max(map(len, names))  # longer than any name of docs
    sized = cut(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), sort_key(F.col("doc_id")).alias("key")), "sized")
    plan = cuts(sized, range_rows)
    whole = docs.select(whole_row(docs), "doc_id", "source", size_of(F.col("text")).alias("size"), sort_key(F.col("doc_id")).alias("key"))
    taken = with_taken(whole, plan).filter("taken > 0").select("row", "size", "taken")
    epoch = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(taken - 1) div size"))).alias("epoch")
    rows = taken.select("row", "size", "taken", epoch).withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size")))
    full = rows.filter("words = size").select("row.*")
    part = rows.filter("words < size").select("row.*", F.col("words").alias(limit))
    schema = docs.schema
    counts = {f.name for f in schema if f.name == "n_chars" and f.dataType.typeName() in ("long", "integer")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [first_words(t, n) for t, n in zip(batch.column("text").to_pylist(), batch.column(limit).to_pylist(), strict=True)]
            new = {"text": lambda kind, t=texts: pa.array(t, kind)} | {c: lambda kind, t=texts: pa.array([len(x) for x in t], kind) for c in counts}
            yield pa.RecordBatch.from_arrays([new[c](batch.column(c).type) if c in new else batch.column(c) for c in names], names=names)

    return full.unionByName(part.mapInArrow(run, schema))


def first_words(text: str, n: int) -> str:
    """text up to the end of its n-th word."""
    import re

    for k, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text), 1):
        if k == n:
            return text[: m.end()]
    return text
