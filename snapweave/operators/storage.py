"""Packs, indexes over them, and maintenance: reachability, liveness, rewriting, tiers and sweeping.

A pack entry has pack_id, logical_id, kind, length and decoded_length. Ratios are compared by integer products.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import varint_length
from ..functions.tables import written

#: Fixed values of the storage format and its policies.
PACK_HEADER_BYTES = 7  # magic 4, version, class and flags of one byte each; the record count follows
PARTIAL_PERCENT = 50
TIER_PACKS = 4
DATA_PACK_TARGET, METADATA_PACK_TARGET = 32 << 20, 4 << 20
SMALL_SAVING, SMALL_SAVING_PERCENT = 64, 5
DELTA_SAVING, DELTA_SAVING_PERCENT = 128, 35
NEAR_PERCENT = 25
REWRITE_RATIO = 4
TOP_CONTENTS = 8
CANDIDATES = 4


def compression_useful(raw: Column, packed: Column) -> Column:
    return raw - packed >= F.greatest(F.lit(SMALL_SAVING), F.floor((raw * SMALL_SAVING_PERCENT + 99) / 100))


def delta_useful(full: Column, delta: Column) -> Column:
    return (full - delta >= DELTA_SAVING) & ((full - delta) * 100 >= full * DELTA_SAVING_PERCENT)


def lengths_near(a: Column, b: Column) -> Column:
    most = F.greatest(a, b)
    return (most > 0) & (F.abs(a - b) * 100 <= most * NEAR_PERCENT)


def rewrite_worthwhile(target: Column, source: Column) -> Column:
    saving = F.greatest(F.lit(DELTA_SAVING), F.floor((target * DELTA_SAVING_PERCENT + 99) / 100))
    return (target > DELTA_SAVING) & (source > 0) & (source <= saving * REWRITE_RATIO)


def fits(addition: Column, current: Column, most: Column) -> Column:
    """Whether something may be added to what there is without passing a maximum; values that make no sense do not fit."""
    return (addition >= 0) & (current >= 0) & (most >= current) & (addition <= most - current)


def additive_capacity(of=F.col) -> Column:
    """Whether a compaction may add its packs before it removes any: objects, index entries and packs must all have room, and, if there is
    a new pack, so must incoming files and bytes for the largest. of(name) gives each of the 13 values."""
    records, packs = of("new_records"), of("new_packs")
    room = lambda addition, what: fits(addition, of(f"current_{what}"), of(f"max_{what}"))
    incoming = room(F.lit(1), "incoming_files") & room(of("largest_incoming_bytes"), "incoming_bytes")
    return room(records, "objects") & room(records, "index_entries") & room(packs, "packs") & ((packs == 0) | incoming)


def tier_convergent(other_same: Column, packs_before: Column, packs_after: Column, bytes_before: Column, bytes_after: Column, source_packs: Column, source_bytes: Column) -> Column:
    return other_same & (source_packs == TIER_PACKS) & (source_bytes > 0) & (packs_after - packs_before < source_packs) & (bytes_after - bytes_before <= source_bytes)


def pack_classes(entries: DataFrame, live: DataFrame) -> DataFrame:
    """pack_id, class (dead, live, partial or keep), live_n, dead_n, live_b, dead_b. live has logical_id, kind."""
    seen = live.select("kind", "logical_id").distinct().withColumn("alive", F.lit(True))
    marked = entries.select("pack_id", "kind", "logical_id", "length").join(seen, ["kind", "logical_id"], "left").withColumn("alive", F.coalesce("alive", F.lit(False)))
    of = lambda alive, x: F.sum(F.when(F.col("alive") == alive, x).otherwise(0))
    sums = marked.groupBy("pack_id").agg(
        of(True, F.lit(1)).alias("live_n"), of(False, F.lit(1)).alias("dead_n"), of(True, F.col("length")).alias("live_b"), of(False, F.col("length")).alias("dead_b")
    )
    much = f"dead_n * 100 >= (live_n + dead_n) * {PARTIAL_PERCENT} or dead_b * 100 >= (live_b + dead_b) * {PARTIAL_PERCENT}"
    kind = F.when(F.col("live_n") == 0, "dead").when(F.col("dead_n") == 0, "live").when(F.expr(much), "partial").otherwise("keep")
    return sums.select("pack_id", kind.alias("class"), "live_n", "dead_n", "live_b", "dead_b")


def duplicate_owners(entries: DataFrame, live: DataFrame) -> DataFrame:
    """logical_id, owner_pack: of live ids in two packs or more, the first pack by id."""
    kept = entries.join(live.select("kind", "logical_id").distinct(), ["kind", "logical_id"], "left_semi")
    return kept.groupBy("kind", "logical_id").agg(F.min("pack_id").alias("owner_pack"), F.max("pack_id").alias("last")).filter("owner_pack <> last").select("logical_id", "owner_pack")


def size_tiers(packs: DataFrame) -> DataFrame:
    """class, tier, pack_id: by class of the packs (class, pack_id, size), the first four of the lowest tier that has four.

    A tier holds packs of one power of two, smaller than a quarter of their class's target. Only counts by tier, then packs of the chosen tiers, are ranked.
    """
    target = F.when(F.col("class") == "metadata", METADATA_PACK_TARGET).otherwise(DATA_PACK_TARGET)
    small = packs.filter(F.col("size") * TIER_PACKS < target).withColumn("tier", F.length(F.bin("size")) - 1)
    chosen = small.groupBy("class", "tier").count().filter(F.col("count") >= TIER_PACKS).groupBy("class").agg(F.min("tier").alias("tier"))
    firsts = small.join(chosen, ["class", "tier"]).withColumn("k", F.row_number().over(Window.partitionBy("class", "tier").orderBy("pack_id")))
    return firsts.filter(F.col("k") <= TIER_PACKS).select("class", "tier", "pack_id")


def ranked_contents(occurrences: DataFrame, lengths: DataFrame, top: int = TOP_CONTENTS) -> DataFrame:
    """path, content_id, n, rank: the contents that a path had most often; shorter ones, then smaller ids, first among equals."""
    counts = occurrences.groupBy("path", "content_id").agg(F.count("*").alias("n")).join(lengths, "content_id")
    order = Window.partitionBy("path").orderBy(F.desc("n"), "decoded_length", "content_id")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("path", "content_id", "n", "rank")


def delta_candidates(contents: DataFrame, lengths: DataFrame, top: int = CANDIDATES) -> DataFrame:
    """path, content_id, anchor_id, rank: of a path's ranked contents, those of near length that come before, nearest first."""
    sized = contents.join(lengths, "content_id")
    a = sized.select("path", F.col("content_id").alias("anchor_id"), F.col("n").alias("an"), F.col("rank").alias("ar"), F.col("decoded_length").alias("al"))
    near = sized.join(a, "path").filter((F.col("ar") < F.col("rank")) & lengths_near(F.col("decoded_length"), F.col("al")))
    order = Window.partitionBy("path", "content_id").orderBy(F.abs(F.col("decoded_length") - F.col("al")), F.desc("an"), "al", "anchor_id")
    return near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= top).select("path", "content_id", "anchor_id", F.col("k").alias("rank"))


def sweep(objects: DataFrame, live: DataFrame, packed: DataFrame, before: Column) -> DataFrame:
    """object_id, reason: expired temporaries, expired dead objects, and live ones that a pack holds too.

    objects has object_id, temporary and modified; what is not older than ``before`` stays.
    """
    both = objects.join(live.select("object_id", F.lit(True).alias("alive")), "object_id", "left").join(packed.select("object_id", F.lit(True).alias("held")), "object_id", "left")
    old = F.col("modified") < before
    reason = F.when(F.col("temporary"), F.when(old, "temporary")).when(F.col("alive").isNull(), F.when(old, "dead")).when(F.col("held"), "superseded")
    return both.select("object_id", reason.alias("reason")).filter("reason is not null")


def reachable(roots: DataFrame, entries: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """kind, logical_id of all that roots (tree_id) reach through entries (tree_id, logical_id), and parts (parent_id, child_id) of those."""
    trees = roots.select("tree_id").distinct()
    content = entries.join(trees, "tree_id", "left_semi").select(F.lit("content").alias("kind"), "logical_id").distinct()
    out = trees.select(F.lit("tree-root").alias("kind"), F.col("tree_id").alias("logical_id")).unionByName(content)
    while parts is not None:
        level = content.join(parts, content.logical_id == parts.parent_id).select("kind", F.col("child_id").alias("logical_id")).distinct()
        content = level.join(out, ["kind", "logical_id"], "left_anti")
        if content.isEmpty():
            break
        out = out.unionByName(content)
    return out


def closures(contents: DataFrame, edges: DataFrame, sizes: DataFrame, most: int = 10) -> DataFrame:
    """content_id, objects, bytes: how many objects each content (content_id) needs, itself included, and what they take.

    edges: parent_id, child_id of recipes and deltas; sizes: logical_id, length. An object counts once a content; deeper than ``most`` is
    an error.
    """
    level = written(contents.select("content_id", F.col("content_id").alias("logical_id")).distinct(), "closure")
    out = level
    for _ in range(most + 1):
        step = level.join(edges, level.logical_id == edges.parent_id).select("content_id", F.col("child_id").alias("logical_id")).distinct()
        level = written(step.join(out, ["content_id", "logical_id"], "left_anti"), "closure")
        if level.isEmpty():
            return out.join(sizes, "logical_id").groupBy("content_id").agg(F.count("*").alias("objects"), F.sum("length").alias("bytes"))
        out = out.unionByName(level)
    raise ValueError("a closure is too deep")


def index_entries(entries: DataFrame) -> DataFrame:
    """logical_id, pack_ordinal, ordinal, offset, length: where each record's frame lies; frames follow the header in id order.

    Packs are numbered by id over the distinct packs alone, of which a store has 65,535 at most.
    """
    packs = entries.groupBy("pack_id").agg(F.count("*").alias("records"))
    packs = packs.withColumn("pack_ordinal", F.row_number().over(Window.orderBy("pack_id")) - 1)
    inside = Window.partitionBy("pack_id").orderBy("logical_id", "kind")
    frame = F.col("length") + varint_length(F.col("length"))
    laid = entries.select("pack_id", "logical_id", "kind", frame.alias("length"), (F.row_number().over(inside) - 1).alias("ordinal"))
    before = F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = laid.withColumn("before", before).join(packs, "pack_id")
    offset = F.lit(PACK_HEADER_BYTES) + varint_length(F.col("records")) + F.col("before")
    return laid.select("logical_id", "pack_ordinal", "ordinal", offset.cast("long").alias("offset"), F.col("length").cast("long").alias("length"))


def fanout(entries: DataFrame) -> DataFrame:
    """bucket (0 to 255, the first byte of the id), cumulative: entries up to and with that bucket."""
    counts = entries.groupBy(F.conv(F.substring("logical_id", 1, 2), 16, 10).cast("int").alias("bucket")).count()
    all_ = entries.sparkSession.range(256).select(F.col("id").cast("int").alias("bucket"))
    total = F.sum(F.coalesce("count", F.lit(0))).over(Window.orderBy("bucket"))
    return all_.join(counts, "bucket", "left").select("bucket", total.alias("cumulative"))


def lookups(wanted: DataFrame, index: DataFrame, footers: DataFrame) -> DataFrame:
    """wanted (logical_id) with state: absent from the index, stale (the pack's footer says otherwise), or current."""
    key = ["logical_id", "pack_ordinal"]
    there = footers.select(*key, F.struct("ordinal", "offset", "length").alias("f"))
    both = index.select(*key, F.struct("ordinal", "offset", "length").alias("i")).join(there, key, "left")
    state = F.when(F.col("i").eqNullSafe(F.col("f")), "current").otherwise("stale")
    met = both.groupBy("logical_id").agg(F.max(state).alias("state"))
    return wanted.select("logical_id").join(met, "logical_id", "left").select("logical_id", F.coalesce("state", F.lit("absent")).alias("state"))


def best_copies(entries: DataFrame, live: DataFrame) -> DataFrame:
    """logical_id, pack_id, length: for each live id its smallest copy (then the first pack); pack_id is null where none survives."""
    best = entries.groupBy("kind", "logical_id").agg(F.min(F.struct("length", "pack_id")).alias("b"))
    return live.select("kind", "logical_id").distinct().join(best, ["kind", "logical_id"], "left").select("logical_id", F.col("b.pack_id").alias("pack_id"), F.col("b.length").alias("length"))


def admit_within_budget(candidates: DataFrame, budget: int, group: str = "class") -> DataFrame:
    """group, key of the candidates (group, key, decoded_length) that fit: in order of key, one that doesn't fit is passed over and
    later ones are still tried. A maintenance pass has 4,096 candidates at most, so a group is one small frame."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, kept = budget, []
        for r in rows.drop_duplicates("key").sort_values("key").itertuples(index=False):
            n = r.decoded_length
            if n == n and n is not None and 0 <= n <= left:
                left -= int(n)
                kept.append((r[0], r.key))
        return pd.DataFrame(kept, columns=[group, "key"])

    return candidates.select(group, "key", F.col("decoded_length").cast("double").alias("decoded_length")).groupBy(group).applyInPandas(run, f"{group} string, key string")


def report(classes: DataFrame, swept: DataFrame) -> DataFrame:
    """One row of counters: packs by class, bytes that a rewrite frees, and swept objects by reason."""
    packs = classes.agg(
        *(F.count_if(F.col("class") == c).alias(f"{c}_packs") for c in ("dead", "partial", "live", "keep")),
        F.sum(F.when(F.col("class").isin("dead", "partial"), F.col("dead_b")).otherwise(0)).alias("freed_bytes"),
    )
    # two single rows
    return packs.join(swept.agg(*(F.count_if(F.col("reason") == r).alias(f"{r}_objects") for r in ("temporary", "dead", "superseded"))), F.lit(True))
