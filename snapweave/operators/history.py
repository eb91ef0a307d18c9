"""Session graphs: projection to stable coordinates, ancestry, validity, and which snapshot each coordinate inherits.

Entries have session_id, entry_id, parent_id (null at a root), ord (append order), type and role. No depth is assumed: pointers
are doubled, so that a chain of n entries takes log2(n) joins, each cut to a table. Pointers that have not ended after as many
rounds as the number of entries allows run in a cycle, which is an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written


def transparent() -> Column:
    return F.col("type") == "label"


def lands_on_parent() -> Column:
    """Whether selecting the entry means its parent: user messages and custom messages."""
    return ((F.col("type") == "message") & (F.col("role") == "user")) | (F.col("type") == "custom_message")


def projection(entries: DataFrame) -> DataFrame:
    """session_id, entry_id, coordinate (stable or transparent), landing (the entry that a selection means), summary."""
    kind = F.when(transparent(), "transparent").otherwise("stable")
    landing = F.when(F.coalesce(lands_on_parent(), F.lit(False)), F.col("parent_id")).otherwise(F.col("entry_id"))
    return entries.select("session_id", "entry_id", kind.alias("coordinate"), landing.alias("landing"), (F.col("type") == "branch_summary").alias("summary"))


def rounds(pointers: DataFrame) -> Iterator[int]:
    """The rounds of doubling that chains of as many pointers can need at most; a further one raises an error."""
    most = pointers.count().bit_length() + 1
    yield from range(most)
    raise ValueError("the parents form a cycle")


def skips(entries: DataFrame) -> DataFrame:
    """session_id, via, next: for each transparent entry, the nearest stable one above it, or null."""
    skip = entries.filter(transparent()).select("session_id", F.col("entry_id").alias("via"), F.col("parent_id").alias("next"))
    skip = written(skip, "skip")
    for _ in rounds(skip):
        on = skip.select("session_id", F.col("via").alias("next"), F.col("next").alias("far"), F.lit(True).alias("more"))
        step = written(skip.join(on, ["session_id", "next"], "left").select("session_id", "via", F.when(F.col("more"), F.col("far")).otherwise(F.col("next")).alias("next"), F.coalesce("more", F.lit(False)).alias("moved")), "skip")
        skip = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    return skip


def stable_graph(entries: DataFrame) -> DataFrame:
    """session_id, entry_id, stable_parent_id, ord for the entries that aren't transparent."""
    own = entries.filter(~transparent())
    both = own.join(skips(entries).select("session_id", F.col("via").alias("parent_id"), "next", F.lit(True).alias("t")), ["session_id", "parent_id"], "left")
    return both.select("session_id", "entry_id", F.when(F.col("t"), F.col("next")).otherwise(F.col("parent_id")).alias("stable_parent_id"), "ord")


def jumps(graph: DataFrame) -> Iterator[DataFrame]:
    """session_id, entry_id, to: one parent up, then two, four and so on, as long as any entry has one so far above."""
    jump = written(graph.filter("stable_parent_id is not null").select("session_id", "entry_id", F.col("stable_parent_id").alias("to")), "jump")
    for _ in rounds(jump):
        if jump.isEmpty():
            return
        yield jump
        on = jump.select("session_id", F.col("entry_id").alias("to"), F.col("to").alias("far"))
        jump = written(jump.join(on, ["session_id", "to"]).select("session_id", "entry_id", F.col("far").alias("to")), "jump")


def ancestry(graph: DataFrame) -> DataFrame:
    """session_id, entry_id, ancestor_id, depth (0 for itself) over stable_parent_id, for every entry.

    The result has a row for each pair, as many as the sum of all depths. What only asks about some entries or pairs has a row an
    entry: above(), depths(), reach_up().
    """
    closure = graph.select("session_id", "entry_id", F.col("entry_id").alias("ancestor_id"), F.lit(0).cast("long").alias("depth"))
    closure, reach = written(closure, "closure"), 1
    for jump in jumps(graph):
        far = closure.select("session_id", F.col("entry_id").alias("to"), "ancestor_id", "depth")
        more = jump.join(far, ["session_id", "to"]).select("session_id", "entry_id", "ancestor_id", (F.col("depth") + reach).alias("depth"))
        closure = written(closure.unionByName(more), "closure")
        reach *= 2
    return closure


def above(graph: DataFrame, leaves: DataFrame, ups: Iterable[DataFrame] | None = None) -> DataFrame:
    """session_id, entry_id of leaves (the same columns) and all their ancestors, each once. ups: jumps(graph), if they are there."""
    found = written(leaves.select("session_id", "entry_id").distinct(), "above")
    for jump in jumps(graph) if ups is None else ups:
        more = found.join(jump, ["session_id", "entry_id"]).select("session_id", F.col("to").alias("entry_id"))
        found = written(found.unionByName(more).distinct(), "above")
    return found


def depths(graph: DataFrame, ups: Iterable[DataFrame] | None = None) -> DataFrame:
    """session_id, entry_id, depth: how many ancestors each entry has."""
    depth = graph.select("session_id", "entry_id", F.col("stable_parent_id").isNotNull().cast("long").alias("depth"))
    depth = written(depth, "depth")
    for jump in jumps(graph) if ups is None else ups:
        far = depth.select("session_id", F.col("entry_id").alias("to"), F.col("depth").alias("more"))
        both = depth.join(jump, ["session_id", "entry_id"], "left").join(far, ["session_id", "to"], "left")
        depth = written(both.select("session_id", "entry_id", (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "depth")
    return depth


def reach_up(graph: DataFrame, asked: DataFrame, ups: Iterable[DataFrame] | None = None) -> DataFrame:
    """session_id, entry_id, steps, reached for asked (session_id, entry_id, steps): the entry so many steps above, or null."""
    at = written(asked.select("session_id", "entry_id", "steps").distinct().withColumn("reached", F.col("entry_id")).withColumn("left", F.col("steps")), "reach")
    for jump in jumps(graph) if ups is None else ups:
        on = jump.select("session_id", F.col("entry_id").alias("reached"), F.col("to").alias("next"))
        odd = F.col("left") % 2 == 1
        moved = at.join(on, ["session_id", "reached"], "left")
        at = written(moved.select("session_id", "entry_id", "steps", F.when(odd, F.col("next")).otherwise(F.col("reached")).alias("reached"), F.floor(F.col("left") / 2).alias("left")), "reach")
    return at.select("session_id", "entry_id", "steps", F.when(F.col("left") == 0, F.col("reached")).alias("reached"))


def violations(entries: DataFrame) -> DataFrame:
    """rule, session_id, entry_id: ids given twice, unknown parents, and parents that don't come before their child."""
    twice = entries.groupBy("session_id", "entry_id").count().filter("count > 1").select(F.lit("duplicate").alias("rule"), "session_id", "entry_id")
    parent = entries.groupBy("session_id", F.col("entry_id").alias("parent_id")).agg(F.min("ord").alias("parent_ord"))
    both = entries.filter("parent_id is not null").join(parent, ["session_id", "parent_id"], "left")
    rule = F.when(F.col("parent_ord").isNull(), "unknown-parent").when(F.col("parent_ord") >= F.col("ord"), "forward-parent")
    return twice.unionByName(both.select(rule.alias("rule"), "session_id", "entry_id").filter("rule is not null").distinct())


def nearest_checkpoint(graph: DataFrame, slots: DataFrame) -> DataFrame:
    """session_id, entry_id, found_at, tree_oid: the nearest checkpoint at or above each entry, null where there is none.

    Each round an entry looks where its pointer leads and takes over that entry's finding and pointer: one row an entry throughout.
    """
    own = slots.filter("tree_oid is not null").select("session_id", "entry_id", F.col("entry_id").alias("found_at"), "tree_oid")
    state = graph.join(own, ["session_id", "entry_id"], "left")
    state = written(state.select("session_id", "entry_id", "found_at", "tree_oid", F.when(F.col("found_at").isNull(), F.col("stable_parent_id")).alias("to")), "lineage")
    for _ in rounds(state):
        if state.filter("to is not null").isEmpty():
            break
        seen = state.select("session_id", F.col("entry_id").alias("to"), F.col("found_at").alias("f"), F.col("tree_oid").alias("o"), F.col("to").alias("t"))
        both = state.join(seen, ["session_id", "to"], "left")
        state = written(both.select("session_id", "entry_id", F.coalesce("found_at", "f").alias("found_at"), F.coalesce("tree_oid", "o").alias("tree_oid"), F.when(F.col("found_at").isNull() & F.col("f").isNull(), F.col("t")).alias("to")), "lineage")
    return state.drop("to")


def resolve(graph: DataFrame, slots: DataFrame) -> DataFrame:
    """nearest_checkpoint(), but nothing for an entry whose own slot is blocked and empty; such ancestors don't hide what is above."""
    shut = slots.filter("tree_oid is null and capture_state = 'blocked'").select("session_id", "entry_id", F.lit(True).alias("shut"))
    both = nearest_checkpoint(graph, slots).join(shut, ["session_id", "entry_id"], "left")
    open_ = F.col("shut").isNull()
    return both.select("session_id", "entry_id", F.when(open_, F.col("found_at")).alias("found_at"), F.when(open_, F.col("tree_oid")).alias("tree_oid"))


def extends(old: DataFrame, new: DataFrame) -> DataFrame:
    """rule, session_id, entry_id by which new (entries) is no append-only extension of old: lost, changed or reordered entries."""
    now = new.select("session_id", "entry_id", F.col("parent_id").alias("p"), F.col("ord").alias("o"), F.col("type").alias("t"))
    both = old.join(now, ["session_id", "entry_id"], "left")
    before = F.max("o").over(Window.partitionBy("session_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    rule = F.when(F.col("o").isNull(), "lost").when(~F.col("p").eqNullSafe(F.col("parent_id")) | ~F.col("t").eqNullSafe(F.col("type")), "changed").when(F.col("o") < before, "reordered")
    return both.select(rule.alias("rule"), "session_id", "entry_id").filter("rule is not null")


def branch_breaks(branch: DataFrame) -> DataFrame:
    """session_id, entry_id of an active branch (in order of ord) whose parent is not the entry before."""
    before = F.lag("entry_id").over(Window.partitionBy("session_id").orderBy("ord"))
    return branch.withColumn("b", before).filter(~F.col("b").eqNullSafe(F.col("parent_id"))).select("session_id", "entry_id")


def navigation(moves: DataFrame, graph: DataFrame, slots: DataFrame, resolved: DataFrame) -> DataFrame:
    """moves (session_id, source_id, target_id, source_kind) with outcome, one of six.

    A target inherits its source if it lies below and neither it nor anything between has a slot: then the entry as many steps above it
    as they differ in depth is the source, and the nearest slot at or above it is no deeper than the source.
    """
    keys = ["session_id", "target_id"]
    ups = list(jumps(graph))
    deep = depths(graph, ups)
    marks = slots.select("session_id", "entry_id", F.lit("slot").alias("tree_oid"))
    nearest = nearest_checkpoint(graph, marks).select("session_id", F.col("entry_id").alias("target_id"), F.col("found_at").alias("entry_id"))
    nearest = nearest.join(deep, ["session_id", "entry_id"]).select(*keys, F.col("depth").alias("slot_depth"))
    of = lambda name, out: deep.select("session_id", F.col("entry_id").alias(name), F.col("depth").alias(out))
    shut = slots.filter("capture_state = 'blocked'").select("session_id", F.col("entry_id").alias("target_id"), F.lit(True).alias("shut"))
    found = resolved.filter("tree_oid is not null").select("session_id", F.col("entry_id").alias("target_id"), F.lit(True).alias("found"))
    met = moves.join(of("source_id", "source_depth"), ["session_id", "source_id"], "left").join(of("target_id", "target_depth"), keys, "left")
    met = written(met.withColumn("steps", F.col("target_depth") - F.col("source_depth")), "moves")
    up = reach_up(graph, met.filter("steps >= 0").select("session_id", F.col("target_id").alias("entry_id"), "steps"), ups).withColumnRenamed("entry_id", "target_id")
    both = met.join(up, [*keys, "steps"], "left").join(nearest, keys, "left").join(shut, keys, "left").join(found, keys, "left")
    has = F.coalesce("found", F.lit(False))
    inherits = (F.col("reached") == F.col("source_id")) & (F.col("slot_depth").isNull() | (F.col("slot_depth") <= F.col("source_depth")))
    outcome = (
        F.when(F.col("target_id").isNull(), "no-node")
        .when(F.col("source_id").eqNullSafe(F.col("target_id")), "same-location")
        .when(F.col("shut"), F.when(has, "restore").otherwise("protected-missing"))
        .when((F.col("source_kind") == "capture") & F.coalesce(inherits, F.lit(False)), "inherit-source")
        .when(has, "restore")
        .when(F.col("source_kind") == "write-protected", "protected-missing")
        .otherwise("materialize-missing")
    )
    return both.select("session_id", "source_id", "target_id", "source_kind", outcome.alias("outcome"))
