"""Planning a compaction: which packs are rewritten, within which budget, on which delta bases, and whether that paid.

Keys are (kind, logical_id) pairs, given as one column ``key``. Selections are tables; each step takes one and returns one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import varint_length
from ..functions.tables import written
from . import chunks, planning, storage

#: Fixed values of the planner.
DECODED_BUDGET = 32 << 20
MAXIMUM_OBJECTS = 4096
MAXIMUM_RECORDS = 65_535
#: Fixed values of the pack layout: bytes of a digest, of the widest varint, of both marks and of the trailer; entries of the fan-out.
DIGEST, WIDEST, MARK, TRAILER, FAN = 32, 8, 4, 72, 256


def pack_bytes_bound(records: Column, bytes_: Column) -> Column:
    """An upper bound of a pack's size from the number and the bytes of its records alone."""
    body = F.lit(MARK + 3) + varint_length(records) + F.when(records > 0, bytes_ + records * varint_length(bytes_)).otherwise(0)
    entry = F.lit(DIGEST + 2 + WIDEST) + varint_length(F.greatest(F.lit(0).cast("long"), records - 1)) + varint_length(body) * 2
    return (body + MARK + 2 + varint_length(records) * (1 + FAN) + records * entry + TRAILER).cast("long")


def best_bases(tried: DataFrame) -> DataFrame:
    """target_id, base_id, payload_bytes: of the deltas that were tried (the same columns; null where none is useful), the
    smallest, then the base with the first id."""
    return tried.filter("payload_bytes is not null").groupBy("target_id").agg(F.min(F.struct("payload_bytes", "base_id")).alias("b")).select("target_id", "b.base_id", "b.payload_bytes")


def opportunistic_source(packs: DataFrame, target_bytes: DataFrame) -> DataFrame:
    """class, pack_id: for each class with selected bytes (class, target), its smallest pack (class, pack_id, size) that is worth
    a rewrite across generations."""
    fit = packs.join(target_bytes, "class").filter(storage.rewrite_worthwhile(F.col("target"), F.col("size")))
    return fit.groupBy("class").agg(F.min(F.struct("size", "pack_id")).alias("p")).select("class", "p.pack_id")


def decoded_lengths(keys: DataFrame, *copies: DataFrame) -> DataFrame:
    """keys (key) with decoded_length, the largest over all copies (key, decoded_length); null where there is none."""
    every = copies[0].select("key", "decoded_length")
    for c in copies[1:]:
        every = every.unionByName(c.select("key", "decoded_length"))
    wanted = keys.select("key").distinct()
    most = every.join(wanted, "key", "left_semi").groupBy("key").agg(F.max("decoded_length").alias("decoded_length"))
    return wanted.join(most, "key", "left")


def bound_decoded(required: DataFrame, lengths: DataFrame, budget: int = DECODED_BUDGET) -> tuple[DataFrame, DataFrame]:
    """The keys (key) that fit the budget, and the packs (pack_id) all of whose required keys (pack_id, key) do.

    lengths (key, decoded_length) covers all selected keys, required or not. A pass has MAXIMUM_OBJECTS of them at most, and
    only the sequential admission sees them as one group.
    """
    kept = storage.admit_within_budget(lengths.select(F.lit("all").alias("class"), "key", "decoded_length"), budget).select("key")
    met = required.join(kept.withColumn("in", F.lit(True)), "key", "left")
    return kept, met.groupBy("pack_id").agg(F.bool_and(F.col("in").isNotNull()).alias("whole")).filter("whole").select("pack_id")


def rewrite_savings(packs: DataFrame, added: DataFrame, deltas: DataFrame) -> DataFrame:
    """pack_id, saved, kept for opportunistic packs (pack_id, size).

    added (pack_id, key): what each brought in. deltas (base_key, target_key, saved): the plan's, with what each saves against
    the full record. One counts for a pack if the pack brought in exactly one of its ends and no such pack brought in the other;
    a target counts once a pack.
    """
    base = added.select("pack_id", F.col("key").alias("base_key"))
    target = added.select("pack_id", F.col("key").alias("target_key"))
    brought = added.select("key").distinct()
    gain = deltas.filter("saved > 0")
    as_base = gain.join(base, "base_key").join(brought.withColumnRenamed("key", "target_key"), "target_key", "left_anti")
    as_target = gain.join(target, "target_key").join(brought.withColumnRenamed("key", "base_key"), "base_key", "left_anti")
    each = as_base.select("pack_id", "target_key", "saved").unionByName(as_target.select("pack_id", "target_key", "saved")).dropDuplicates(["pack_id", "target_key"])
    sums = each.groupBy("pack_id").agg(F.sum("saved").alias("saved"))
    met = packs.join(sums, "pack_id", "left").withColumn("saved", F.coalesce("saved", F.lit(0)))
    return met.select("pack_id", "saved", ((F.col("saved") > 0) & (F.col("size") <= F.col("saved") * storage.REWRITE_RATIO)).alias("kept"))


def prune(selected: DataFrame, required: DataFrame, added: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keys (key) and packs (pack_id) that remain after rewrites that did not pay (judged: rewrite_savings()) are dropped.

    A key that a dropped pack brought in stays if a remaining pack requires it (required: pack_id, key).
    """
    failed = judged.filter("not kept").select("pack_id")
    needs = required.join(failed, "pack_id", "left_anti")
    gone = added.join(failed, "pack_id", "left_semi").select("key").join(needs.select("key"), "key", "left_anti")
    return selected.select("key").join(gone, "key", "left_anti"), needs.select("pack_id").distinct()


def extend_with_tier(selected: DataFrame, group: DataFrame, used_bytes: int, budget: int = DECODED_BUDGET, most: int = MAXIMUM_OBJECTS) -> DataFrame:
    """selected (key), and the keys of group (pack_id, key, decoded_length: a size tier's packs) if all of the new ones fit the
    budget and the number of objects; otherwise selected alone. Copies of a key that disagree on their length are an error."""
    one = group.groupBy("key").agg(F.max("decoded_length").alias("n"), F.min("decoded_length").alias("low"))
    agreed = one.select("key", F.when(F.col("n") == F.col("low"), F.col("n")).otherwise(F.raise_error(F.lit("copies differ in decoded length")).cast("long")).alias("n"))
    new = agreed.join(selected.select("key"), "key", "left_anti")
    had = selected.select("key").distinct().count()
    room = new.agg(F.count("*").alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("b")).filter((F.col("c") <= most - had) & (F.col("b") <= budget - used_bytes)).select(F.lit(True).alias("fits"))
    return selected.select("key").unionByName(new.join(F.broadcast(room), F.col("fits")).select("key"))


def plan(records: DataFrame, bases: DataFrame, target: int = storage.DATA_PACK_TARGET) -> tuple[DataFrame, DataFrame]:
    """Batches and dependencies of a compaction, whatever the order of the input.

    records (class, key, length) go to batches of about target bytes in order of key; a delta (bases: target_id, base_id) goes
    to its base's batch, right after it. Returns (class, key, batch) and (batch, target_id, base_id).
    """
    root = bases.select(F.col("target_id").alias("key"), F.col("base_id").alias("lead"))
    led = records.join(root, "key", "left").withColumn("lead", F.coalesce("lead", "key"))
    units = led.groupBy("class", F.col("lead").alias("key")).agg(F.sum("length").alias("length"))
    batch = planning.batches(units, target).withColumnRenamed("key", "lead")
    placed = led.join(batch, ["class", "lead"]).select("class", "key", "batch")
    facts = bases.join(placed.select("batch", F.col("key").alias("target_id")), "target_id").select("batch", "target_id", "base_id")
    return placed, facts


def plan_metrics(placed: DataFrame, records: DataFrame) -> DataFrame:
    """class, packs, records, bytes of a plan."""
    return placed.join(records.select("class", "key", "length"), ["class", "key"]).groupBy("class").agg(F.countDistinct("batch").alias("packs"), F.count("*").alias("records"), F.sum("length").alias("bytes"))


def inventory_totals(entries: DataFrame) -> DataFrame:
    """One row: packs, records, bytes and distinct keys of pack entries (pack_id, kind, logical_id, length)."""
    return entries.agg(F.countDistinct("pack_id").alias("packs"), F.count("*").alias("records"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.countDistinct("kind", "logical_id").alias("keys"))


def root_drift(*reads: DataFrame) -> DataFrame:
    """tree_oid, reads of roots that not every one of several reads (tree_oid) has. Empty if the roots held still."""
    tagged = [r.select("tree_oid").distinct().withColumn("r", F.lit(k)) for k, r in enumerate(reads)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    return every.groupBy("tree_oid").agg(F.count("*").alias("reads")).filter(F.col("reads") < len(reads))


def large_legacy(contents: DataFrame, small: int = 64 << 10, minimum: int = 16 << 10) -> DataFrame:
    """content_id, at_most: contents (content_id, byte_length) that must become chunks, and the most objects that can take: a chunk
    for each minimum length, and the recipe over them."""
    chunks = F.ceil(F.col("byte_length") / minimum)
    return contents.filter(F.col("byte_length") > small).select("content_id", (chunks + F.ceil(chunks / 768) + F.ceil(chunks / (768 * 480)) + 1).cast("long").alias("at_most"))


def convert_large(contents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What large contents (content_id, content) become: their chunks (chunks.chunk()), their recipe objects (chunks.RECIPE_NODE), and the
    records that refer to the recipes' roots (content_id, recipe_id, decoded_length). One chunk alone stays a whole record."""
    big = contents.filter(F.octet_length("content") > chunks.AVERAGE)
    found = written(chunks.chunk(big), "chunks")
    recipes = written(chunks.recipe_objects(found), "recipes")
    return found, recipes, recipes.filter("level = -1").select("content_id", "recipe_id", "decoded_length")


def collect(entries: DataFrame, objects: DataFrame, read_roots, reach, publish, now_ms: int, grace_ms: int = 3_600_000) -> DataFrame:
    """cycle() at a moment, with the grace that unreferenced objects are given; objects.modified is in milliseconds."""
    if grace_ms < 0:
        raise ValueError("a grace is not negative")
    return cycle(entries, objects, read_roots, reach, publish, F.lit(now_ms - grace_ms))


def pack_class(kind: Column) -> Column:
    return F.when(kind == "content", "data").otherwise("metadata")


def with_tiers(entries: DataFrame, classes: DataFrame, records: DataFrame, whole: DataFrame, kept: DataFrame, used_bytes: int, budget: int, target: int) -> tuple[DataFrame, DataFrame]:
    """records (class, key, length) and whole (pack_id) with the packs of one size tier of each pack class that are fully live and whose
    rewriting converges: fewer packs and no more bytes than before. A trial plan tells."""
    key = F.concat_ws(":", "kind", "logical_id").alias("key")
    sizes = entries.join(classes.filter("class = 'live'").select("pack_id"), "pack_id", "left_semi").groupBy("pack_id", pack_class(F.col("kind")).alias("class")).agg(F.sum("length").alias("size"))
    chosen = written(storage.size_tiers(sizes.join(whole, "pack_id", "left_anti")).join(sizes.select("pack_id", "size"), "pack_id"), "tiers")
    none = records.select(F.col("key").alias("target_id"), F.col("key").alias("base_id")).limit(0)
    for name in ("data", "metadata"):
        packs = chosen.filter(F.col("class") == name)
        source_packs, source_bytes = packs.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        if source_packs < storage.TIER_PACKS:
            continue
        group = written(entries.join(packs.select("pack_id"), "pack_id", "left_semi").select("pack_id", key, "kind", "length", "decoded_length"), "tier")
        more = extend_with_tier(kept, group, used_bytes, budget).join(kept, "key", "left_anti")
        added = group.join(more, "key", "left_semi").groupBy(F.col("kind").alias("class"), "key").agg(F.min("length").alias("length"))
        both = written(records.unionByName(added), "records")
        count = lambda r: plan_metrics(plan(r, none, target)[0], r).agg(F.coalesce(F.sum("packs"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        (packs_before, bytes_before), (packs_after, bytes_after) = count(records), count(both)
        values = [F.lit(x) for x in (True, packs_before, packs_after, bytes_before, bytes_after, source_packs, source_bytes)]
        if not added.isEmpty() and both.sparkSession.range(1).select(storage.tier_convergent(*values)).first()[0]:
            records, whole, kept = both, written(whole.unionByName(packs.select("pack_id")), "whole"), kept.unionByName(more)
    return records, whole


def cycle(entries: DataFrame, objects: DataFrame, read_roots, reach, publish, expired: Column, budget: int = DECODED_BUDGET, bases: DataFrame | None = None, target: int = storage.DATA_PACK_TARGET) -> DataFrame:
    """A whole pass: mark, select, bound, extend by size tiers, plan, publish, mark again, sweep. One row of counters.

    bases (target_id, base_id: keys), if given, are the deltas that the plan makes, as far as both ends are rewritten.
    entries: pack_id, kind, logical_id, length, decoded_length. objects: object_id, temporary, modified. read_roots() gives the
    roots (tree_oid), reach(roots) what lives (kind, logical_id), publish(placed, records) writes the new packs; expired tells the
    moment before which dead objects go. Roots are read three times, and nothing is swept unless they held still.
    """
    key = F.concat_ws(":", "kind", "logical_id").alias("key")
    first = read_roots()
    live = reach(first)
    classes = storage.pack_classes(entries, live)
    chosen = entries.join(classes.filter("class = 'partial'").select("pack_id"), "pack_id", "left_semi").join(live, ["kind", "logical_id"], "left_semi")
    required = chosen.select("pack_id", key).distinct()
    kept, whole = bound_decoded(required, decoded_lengths(required, entries.select(key, "decoded_length")), budget)
    records = chosen.join(whole, "pack_id", "left_semi").select(F.col("kind").alias("class"), key, "length").groupBy("class", "key").agg(F.min("length").alias("length"))
    used = entries.select(key, "decoded_length").join(kept, "key", "left_semi").groupBy("key").agg(F.max("decoded_length").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    records, whole = with_tiers(entries, classes, written(records, "records"), written(whole, "whole"), written(kept, "kept"), used, budget, target)
    asked = bases if bases is not None else records.select(F.col("key").alias("target_id"), F.col("key").alias("base_id")).limit(0)
    ends = [records.select(F.col("key").alias(c)) for c in ("target_id", "base_id")]
    placed, _ = plan(records, asked.join(ends[0], "target_id", "left_semi").join(ends[1], "base_id", "left_semi"), target)
    publish(placed, records)
    second = read_roots()
    again = reach(second)
    packed = entries.join(whole, "pack_id", "left_anti").select(F.col("logical_id").alias("object_id")).distinct()
    swept = storage.sweep(objects, again.select(F.col("logical_id").alias("object_id")).distinct(), packed, expired)
    held = root_drift(first, second, read_roots()).isEmpty()
    told = storage.report(classes, swept if held else swept.limit(0))
    return told.withColumn("rewritten_packs", F.lit(whole.count())).withColumn("held_still", F.lit(held))
