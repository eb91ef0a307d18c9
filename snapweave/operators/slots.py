"""Checkpoint slots: a coordinate's state and the batches of requests that change it.

A slot row has session_id, entry_id, tree_oid and capture_state (open or blocked); a coordinate without a row is open and
empty, and a row without tree_oid is blocked. Parquet tables know no MERGE: each operator returns the table as it is after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["session_id", "entry_id"]


def state() -> object:
    return (
        F.when(F.col("capture_state").isNull(), "open-missing")
        .when(F.col("tree_oid").isNull(), "blocked-missing")
        .otherwise(F.concat(F.col("capture_state"), F.lit("-checkpoint")))
    )


def read(coordinates: DataFrame, slots: DataFrame) -> DataFrame:
    """coordinates with tree_oid, capture_state and slot, one of four states."""
    return coordinates.join(slots, KEY, "left").withColumn("slot", state())


def transition(requests: DataFrame, slots: DataFrame) -> DataFrame:
    """requests (KEY, op, oid) with the state they meet, the outcome, and the slot after it.

    capture writes an open slot; block closes one and pins oid, the inherited tree; release opens the pinned tree that it
    names; adopt fills a slot that is blocked and empty. Whatever else is asked is rejected and changes nothing.
    """
    met = read(requests, slots)
    s, op = F.col("slot"), F.col("op")
    shut = s.startswith("blocked")
    outcome = (
        F.when(op == "capture", F.when(shut, "capture-blocked").otherwise("applied"))
        .when(op == "block", "applied")
        .when(op == "release", F.when((s == "blocked-checkpoint") & (F.col("tree_oid") == F.col("oid")), "applied").otherwise("checkpoint-mismatch"))
        .when(op == "adopt", F.when(s == "blocked-missing", "applied").otherwise("not-blocked-missing"))
    )
    done = F.col("outcome") == "applied"
    new_oid = F.when(done & op.isin("capture", "release", "adopt"), F.col("oid")).when(done & (op == "block") & (s == "open-missing"), F.col("oid")).otherwise(F.col("tree_oid"))
    new_state = F.when(done & op.isin("capture", "release", "adopt"), "open").when(done & (op == "block"), "blocked").otherwise(F.col("capture_state"))
    return met.withColumn("outcome", outcome).select(*KEY, "op", F.col("slot").alias("before"), "outcome", new_oid.alias("new_oid"), new_state.alias("new_state"))


def commit_captures(requests: DataFrame, slots: DataFrame) -> DataFrame:
    """requests (KEY, oid, expected_oid, expected_state) with outcome: blocked, slot-changed or committed. One request a coordinate."""
    met = read(requests, slots)
    same = F.col("tree_oid").eqNullSafe(F.col("expected_oid")) & F.col("capture_state").eqNullSafe(F.col("expected_state"))
    outcome = F.when(F.col("slot").startswith("blocked"), "blocked").when(~same, "slot-changed").otherwise("committed")
    return met.select(*KEY, "oid", outcome.alias("outcome"))


def upsert(slots: DataFrame, changes: DataFrame) -> DataFrame:
    """slots, with the rows of changes instead of or beside them."""
    return slots.join(changes.select(*KEY), KEY, "left_anti").unionByName(changes.select(*slots.columns))


def reconcile_barrier(branch: DataFrame, slots: DataFrame, nearest: DataFrame) -> DataFrame:
    """The slot table after every coordinate of branch (KEY: the active ancestry of sessions with a barrier) is closed.

    An open slot keeps its tree; an empty one pins the nearest tree above, if there is one. nearest is history.nearest_checkpoint().
    """
    met = read(branch.select(*KEY), slots).join(nearest.select(*KEY, F.col("tree_oid").alias("near")), KEY, "left")
    changed = met.filter(F.col("slot").startswith("open")).select(*KEY, F.coalesce("tree_oid", "near").alias("tree_oid"), F.lit("blocked").alias("capture_state"))
    return upsert(slots.select(*KEY, "tree_oid", "capture_state"), changed)


def from_guards(states: DataFrame, guards: DataFrame) -> DataFrame:
    """The slot table of an older layout: states (KEY, tree_oid) are blocked where a guard (KEY) stands; guards alone are blocked and empty."""
    guard = guards.select(*KEY).distinct()
    kept = states.join(guard.withColumn("g", F.lit(True)), KEY, "left").select(*KEY, "tree_oid", F.when(F.col("g"), "blocked").otherwise("open").alias("capture_state"))
    alone = guard.join(states, KEY, "left_anti").select(*KEY, F.lit(None).cast("string").alias("tree_oid"), F.lit("blocked").alias("capture_state"))
    return kept.unionByName(alone)


def replace_roots(slots: DataFrame, mapping: DataFrame) -> DataFrame:
    """slots with tree_oid replaced where mapping (old_oid, new_oid) has it."""
    both = slots.join(mapping, slots.tree_oid == mapping.old_oid, "left")
    return both.select(*KEY, F.coalesce("new_oid", "tree_oid").alias("tree_oid"), "capture_state")


def project_fork(retained: DataFrame, source: DataFrame, leaf: DataFrame) -> DataFrame:
    """Slots of a fork: each retained coordinate (session_id of the fork, source_session, entry_id) takes its source's slot; without
    one it is blocked and empty, except the leaf, which stays open (and so without a row)."""
    from_ = source.select(F.col("session_id").alias("source_session"), "entry_id", "tree_oid", "capture_state")
    both = retained.join(from_, ["source_session", "entry_id"], "left").join(leaf.select(*KEY, F.lit(True).alias("leaf")), KEY, "left")
    kept = both.filter(F.col("capture_state").isNotNull() | F.col("leaf").isNull())
    return kept.select(*KEY, "tree_oid", F.coalesce("capture_state", F.lit("blocked")).alias("capture_state"))


def verify_pending(retained: DataFrame, slots: DataFrame) -> DataFrame:
    """The slot table after a pending session is verified: retained coordinates (KEY) without a slot become blocked and empty."""
    new = retained.select(*KEY).join(slots, KEY, "left_anti").select(*KEY, F.lit(None).cast("string").alias("tree_oid"), F.lit("blocked").alias("capture_state"))
    return slots.select(*KEY, "tree_oid", "capture_state").unionByName(new)


def match_identity(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """claims (session_id, session_file) with outcome: absent, exact, or conflict where either half is registered otherwise."""
    r = registry.select(F.col("session_id").alias("r_id"), F.col("session_file").alias("r_file"))
    by_id = claims.join(r, claims.session_id == r.r_id).select("session_id", "session_file", (F.col("r_file") == F.col("session_file")).alias("ok"))
    by_file = claims.join(r, claims.session_file == r.r_file).select("session_id", "session_file", (F.col("r_id") == F.col("session_id")).alias("ok"))
    met = by_id.unionByName(by_file).groupBy("session_id", "session_file").agg(F.bool_and("ok").alias("ok"))
    outcome = F.when(F.col("ok").isNull(), "absent").when(F.col("ok"), "exact").otherwise("conflict")
    return claims.join(met, ["session_id", "session_file"], "left").select("session_id", "session_file", outcome.alias("outcome"))


def violations(slots: DataFrame, known: DataFrame) -> DataFrame:
    """rule, KEY: coordinates with two rows, open rows without a tree, and rows outside of the known coordinates."""
    twice = slots.groupBy(*KEY).count().filter("count > 1").select(F.lit("duplicate").alias("rule"), *KEY)
    empty = slots.filter("capture_state = 'open' and tree_oid is null").select(F.lit("open-without-tree").alias("rule"), *KEY)
    outside = slots.join(known.select(*KEY), KEY, "left_anti").select(F.lit("outside-graph").alias("rule"), *KEY)
    return twice.unionByName(empty).unionByName(outside.distinct())
