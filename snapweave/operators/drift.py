"""Comparing a workspace with a saved snapshot: what to create, delete, modify, what blocks it, and in which order to act.

Entries have path, kind (regular or symlink), oid (regular) and target (symlink). Modes are not compared: a change of mode
alone is no drift.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from .trees import display_path


def _joined(current: DataFrame, saved: DataFrame) -> DataFrame:
    return current.alias("c").join(saved.alias("t"), F.col("c.path") == F.col("t.path"), "full_outer")


def _same() -> object:
    return F.col("c.kind").eqNullSafe(F.col("t.kind")) & F.col("c.oid").eqNullSafe(F.col("t.oid")) & F.col("c.target").eqNullSafe(F.col("t.target"))


def actions(current: DataFrame, saved: DataFrame, scopes_match: bool = True) -> DataFrame:
    """action (created, deleted, modified), path. Where the scopes differ the inventory is incomplete, so nothing is deleted."""
    action = F.when(F.col("t.path").isNull(), F.lit("deleted") if scopes_match else F.lit(None)).when(F.col("c.path").isNull(), "created").when(~_same(), "modified")
    return _joined(current, saved).select(action.alias("action"), F.coalesce("t.path", "c.path").alias("path")).filter("action is not null")


def required_blobs(current: DataFrame, saved: DataFrame) -> DataFrame:
    """blob_oid of saved regular files that the workspace lacks at their path."""
    both = saved.filter("kind = 'regular'").alias("t").join(current.alias("c"), F.col("c.path") == F.col("t.path"), "left")
    held = F.col("c.kind").eqNullSafe(F.lit("regular")) & F.col("c.oid").eqNullSafe(F.col("t.oid"))
    return both.filter(~held).select(F.col("t.oid").alias("blob_oid")).distinct()


def scope_blockers(excluded: DataFrame, saved: DataFrame) -> DataFrame:
    """path, target_path: excluded occupancies at or below a saved entry (the nearest), or where a saved entry needs a directory.

    Paths are exploded to their ancestors, so that what would be a range join is an equi-join.
    """
    up = excluded.select("path", F.explode(F.array_append(paths.ancestors(F.col("path")), F.col("path"))).alias("at"))
    under = up.join(saved.select(F.col("path").alias("at")), "at").groupBy("path").agg(F.max_by("at", F.octet_length("at")).alias("entry"))
    dirs = saved.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct().withColumn("dir", F.col("path"))
    both = excluded.select("path").distinct().join(under, "path", "left").join(dirs, "path", "left")
    return both.select("path", F.coalesce("entry", "dir").alias("target_path")).filter("target_path is not null")


def occupancy_changed(current: DataFrame, expected: DataFrame) -> DataFrame:
    """path of excluded occupancies (path, kind) that are only on one side, or of another kind."""
    both = current.alias("c").join(expected.alias("e"), F.col("c.path") == F.col("e.path"), "full_outer")
    return both.filter(~F.col("c.kind").eqNullSafe(F.col("e.kind"))).select(F.coalesce("c.path", "e.path").alias("path"))


def directories(entries: DataFrame) -> DataFrame:
    """path of every directory that entries lie in."""
    return entries.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()


def renames(current: DataFrame, saved: DataFrame) -> DataFrame:
    """from_path, path of directories that the workspace spells otherwise than the snapshot does: the same to a file system that folds
    names, under another last component. The spelling of what is above them is another row's matter."""
    here, want = directories(current), directories(saved)
    there = here.select(F.col("path").alias("from_path"), paths.portable_key(F.col("path")).alias("k"))
    new = want.join(here, "path", "left_anti").withColumn("k", paths.portable_key(F.col("path")))
    both = new.join(there, "k").filter(paths.basename(F.col("path")) != paths.basename(F.col("from_path")))
    return both.groupBy("path").agg(F.min("from_path").alias("from_path")).select("from_path", "path")


def apply_order(current: DataFrame, saved: DataFrame) -> DataFrame:
    """step, depth, path of the actions, sorted as they must run: directories spelled anew shallowest first, deletions, emptied
    directories deepest first, new directories shallowest first, files, then symlinks. depth is negative where the deepest comes first."""
    plan = actions(current, saved).join(saved.select("path", F.col("kind").alias("k")), "path", "left")
    before, after = directories(current), directories(saved)
    steps = [
        renames(current, saved).select(F.lit(0).alias("step"), paths.depth(F.col("path")).alias("depth"), "path"),
        plan.filter("action = 'deleted'").select(F.lit(1).alias("step"), F.lit(0).alias("depth"), "path"),
        before.join(after, "path", "left_anti").select(F.lit(2).alias("step"), (-paths.depth(F.col("path"))).alias("depth"), "path"),
        after.join(before, "path", "left_anti").select(F.lit(3).alias("step"), paths.depth(F.col("path")).alias("depth"), "path"),
        plan.filter("action <> 'deleted'").select(F.when(F.col("k") == "symlink", 5).otherwise(4).alias("step"), F.lit(0).alias("depth"), "path"),
    ]
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out.orderBy("step", "depth", "path")


def summary(current: DataFrame, saved: DataFrame) -> DataFrame:
    """One row: counts of each action (renamed: directories spelled otherwise), what is unchanged, how many actions there are, and
    whether there is anything to do."""
    both = _joined(current, saved).select(F.col("c.path").alias("c"), F.col("t.path").alias("t"), _same().alias("same"))
    n = lambda cond: F.count_if(cond)
    row = both.agg(
        n(F.col("c").isNull()).alias("created"),
        n(F.col("t").isNull()).alias("deleted"),
        n(F.col("c").isNotNull() & F.col("t").isNotNull() & ~F.col("same")).alias("modified"),
        n(F.col("c").isNotNull() & F.col("t").isNotNull() & F.col("same")).alias("unchanged"),
    )
    # two single rows
    row = row.join(renames(current, saved).agg(F.count("*").alias("renamed")), F.lit(True))
    return row.withColumn("actions", F.expr("created + deleted + modified + renamed")).withColumn("has_changes", F.col("actions") > 0)


def preview(current: DataFrame, saved: DataFrame) -> DataFrame:
    """line: a sign and the path, as a terminal may show it, for each action: deletions (-), modifications (~), directories spelled anew
    (>, both spellings) and creations (+), each sorted by UTF-16 code units; ord is the line's place."""
    rank = F.create_map(*(x for k, a in enumerate(("deleted", "modified", "renamed", "created")) for x in (F.lit(a), F.lit(k))))
    plain = actions(current, saved).select("action", "path", F.lit(None).cast("string").alias("from_path"))
    every = plain.unionByName(renames(current, saved).select(F.lit("renamed").alias("action"), "path", "from_path"))
    sign = F.element_at(F.array(*map(F.lit, "-~>+")), rank[F.col("action")] + 1)
    shown = lambda c: display_path(F.col(c))
    line = F.when(F.col("from_path").isNull(), F.concat_ws(" ", sign, shown("path"))).otherwise(F.concat_ws(" ", sign, shown("from_path"), F.lit("\u2192"), shown("path")))
    ord_ = F.row_number().over(Window.partitionBy("r").orderBy(paths.utf16_key(F.col("path"))))
    lines = every.withColumn("r", rank[F.col("action")])
    return lines.select("r", ord_.alias("ord"), line.alias("line"))


def stable(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows by which two scans differ, mode included: empty if the workspace held still."""
    a = first.exceptAll(second).withColumn("side", F.lit("first"))
    return a.unionByName(second.exceptAll(first).withColumn("side", F.lit("second")))


def aliases(current: DataFrame, saved: DataFrame) -> DataFrame:
    """path, current_path, by: saved paths that the workspace holds under another spelling, by portable key or else by file identity.

    current has path and identity (null where unknown), saved path and identity.
    """
    here = current.select(F.col("path").alias("current_path"), F.col("identity").alias("i"), paths.portable_key(F.col("path")).alias("k"))
    want = saved.select("path", "identity", paths.portable_key(F.col("path")).alias("k")).join(current.select("path"), "path", "left_anti")
    spelled = want.join(here, "k").select("path", "current_path", F.lit("spelling").alias("by"))
    rest = want.join(spelled.select("path").distinct(), "path", "left_anti")
    moved = rest.join(here.drop("k"), F.col("identity") == F.col("i")).select("path", "current_path", F.lit("identity").alias("by"))
    return spelled.unionByName(moved)
