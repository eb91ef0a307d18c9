"""Judgements on sessions: natural descent, arrivals, extension by position, and how a fork is registered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import history, slots

KEY = ["session_id", "entry_id"]

#: Why a fork's source cannot be inherited from.
REASONS = (
    "invalid-parent-claim",
    "parent-source-missing",
    "parent-source-invalid",
    "parent-claim-changed",
    "parent-graph-rewritten",
    "unsafe-source-topology",
    "source-store-missing",
    "source-registration-absent",
    "source-registration-conflict",
    "source-registration-unverified",
    "source-metadata-recovery-required",
    "source-metadata-unrecognized",
    "source-projection-invalid",
    "target-import-rejected",
)


def landings(entries: DataFrame) -> DataFrame:
    """session_id, entry_id, landing_id: the entry itself if stable, else the nearest stable one above, or null at a root."""
    stable = history.stable_graph(entries).select(*KEY, F.col("entry_id").alias("landing_id"))
    skipped = history.skips(entries).select("session_id", F.col("via").alias("entry_id"), F.col("next").alias("landing_id"))
    return stable.unionByName(skipped)


def natural_descent(old: DataFrame, new: DataFrame, claims: DataFrame) -> DataFrame:
    """claims (session_id, ancestor_id or null, descendant_id) with ``natural``: the descendant is stable and new, the session only
    grew, and the first stable entry above it that was known before is the ancestor (null: none was known).

    Each entry's nearest known one is found by doubled pointers, a row an entry; no closure is built.
    """
    graph = history.stable_graph(new)
    stable_before = old.filter(~history.transparent()).select(*KEY)
    known = stable_before.withColumn("tree_oid", F.col("entry_id").cast("string"))
    nearest = history.nearest_checkpoint(graph, known).select("session_id", F.col("entry_id").alias("descendant_id"), F.col("found_at").alias("first_known"), F.lit(True).alias("there"))
    before = old.select("session_id", F.col("entry_id").alias("descendant_id"), F.lit(True).alias("seen")).distinct()
    ancestor = stable_before.select("session_id", F.col("entry_id").alias("ancestor_id"), F.lit(True).alias("proper")).distinct()
    broken = history.extends(old, new).select("session_id", F.lit(True).alias("broken")).distinct()
    met = claims.join(nearest, ["session_id", "descendant_id"], "left").join(before, ["session_id", "descendant_id"], "left")
    met = met.join(ancestor, ["session_id", "ancestor_id"], "left").join(broken, "session_id", "left")
    natural = F.col("there").isNotNull() & F.col("seen").isNull() & F.col("broken").isNull() & (F.col("ancestor_id").isNull() | F.col("proper").isNotNull())
    return met.select("session_id", "ancestor_id", "descendant_id", (natural & F.col("first_known").eqNullSafe(F.col("ancestor_id"))).alias("natural"))


def arrivals(events: DataFrame, entries: DataFrame) -> DataFrame:
    """events with landing_id and kind: direct, summary or rejected.

    events: session_id, event_id, old_leaf, new_leaf, leaf (the session's), expected_old, expected (where it should land),
    summary_id and summary_parent (null without a summary). A summary must itself be where the arrival lands, be a summary
    entry under the parent that it names, and that parent must land where expected.
    """
    land = landings(entries)
    at = lambda key, out: land.select("session_id", F.col("entry_id").alias(key), F.col("landing_id").alias(out), F.lit(True).alias(f"{out}_known"))
    entry = entries.filter("type = 'branch_summary'").select("session_id", F.col("entry_id").alias("summary_id"), F.col("parent_id").alias("own_parent"), F.lit(True).alias("is_summary"))
    met = events.join(at("new_leaf", "landing_id"), ["session_id", "new_leaf"], "left").join(at("summary_parent", "above"), ["session_id", "summary_parent"], "left")
    met = met.join(entry, ["session_id", "summary_id"], "left")
    same = F.col("old_leaf").eqNullSafe(F.col("expected_old")) & F.col("new_leaf").eqNullSafe(F.col("leaf"))
    direct = F.col("landing_id").eqNullSafe(F.col("expected")) & (F.col("new_leaf").isNull() | F.col("landing_id_known"))
    known_above = F.col("summary_parent").isNull() | F.col("above_known")
    summary = F.col("is_summary") & F.col("own_parent").eqNullSafe(F.col("summary_parent")) & (F.col("landing_id") == F.col("summary_id")) & known_above & F.col("above").eqNullSafe(F.col("expected"))
    kind = F.when(same & F.col("summary_id").isNull() & direct, "direct").when(same & F.col("summary_id").isNotNull() & summary, "summary").otherwise("rejected")
    return met.select("session_id", "event_id", F.when(kind != "rejected", F.col("landing_id")).alias("landing_id"), kind.alias("kind"))


def coordinates_extend(prefix: DataFrame, current: DataFrame) -> DataFrame:
    """session_id, extends: whether each coordinate of prefix (session_id, pos, entry_id, stable_parent_id, type, role) is the
    one at its place in current."""
    what = ["entry_id", "stable_parent_id", "type", "role"]
    now = current.select("session_id", "pos", F.struct(*what).alias("now"))
    both = prefix.select("session_id", "pos", F.struct(*what).alias("then")).join(now, ["session_id", "pos"], "left")
    return both.groupBy("session_id").agg(F.bool_and(F.col("then").eqNullSafe(F.col("now"))).alias("extends"))


def registration(claims: DataFrame) -> DataFrame:
    """session_id, disposition (present, fresh, inherit, import, quarantine or retry) and reason (one of REASONS, or null).

    claims: registered (the target already is), claim (independent, rejected, indeterminate or observed), reason (of a rejected
    claim), local (the source's workspace is the target's), identity (absent, exact or conflict, slots.match_identity()),
    verified (the source's registration), again (the reason why the source, read again, is rejected, or null), unchanged,
    exact (the exported projection holds proven ids only), self (source and target are one), isolated (the other store is safe).
    The first rule that applies decides.
    """
    quarantine = lambda reason: F.struct(F.lit("quarantine").alias("disposition"), reason.alias("reason"))
    because = lambda text: quarantine(F.lit(text))
    plain = lambda text: F.struct(F.lit(text).alias("disposition"), F.lit(None).cast("string").alias("reason"))
    home = F.col("local") & (F.col("identity") == "exact")
    rule = (
        F.when(F.col("registered"), plain("present"))
        .when(F.col("claim") == "independent", plain("fresh"))
        .when(F.col("claim") == "rejected", quarantine(F.col("reason")))
        .when(F.col("claim") == "indeterminate", plain("retry"))
        .when(F.col("local") & (F.col("identity") == "conflict"), because("source-registration-conflict"))
        .when(home & ~F.col("verified"), because("source-registration-unverified"))
        .when(F.col("again").isNotNull(), quarantine(F.col("again")))
        .when(home & ~F.col("unchanged"), because("parent-claim-changed"))
        .when(home & ~F.col("exact"), because("source-projection-invalid"))
        .when(home, plain("inherit"))
        .when(F.col("self"), because("source-registration-conflict"))
        .when(F.col("local"), because("source-registration-absent"))
        .when(~F.col("isolated"), because("unsafe-source-topology"))
        .otherwise(plain("import"))
    )
    return claims.withColumn("_r", rule).select("session_id", "_r.disposition", "_r.reason")


def materialize(requests: DataFrame, table: DataFrame) -> DataFrame:
    """requests (KEY, intent, oid) as slots.transition(): a fresh node is captured, a protected one adopted."""
    op = F.when(F.col("intent") == "initialise-fresh", "capture").when(F.col("intent") == "adopt-protected", "adopt")
    done = slots.transition(requests.select(*KEY, op.alias("op"), "oid"), table)
    wrong = (F.col("op") == "capture") & (F.col("before") != "open-missing") & (F.col("outcome") == "applied")
    return done.withColumn("outcome", F.when(wrong, "slot-changed").otherwise(F.col("outcome"))).select(*KEY, "op", "before", "outcome")


def due(now: Column, last: Column, interval: Column) -> Column:
    """Whether automatic maintenance is due. An interval of 0 or less switches it off; without a last run it is due."""
    return (interval > 0) & (F.coalesce(last, F.lit(0)) + interval <= now)
