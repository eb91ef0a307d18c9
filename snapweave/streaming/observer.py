"""Observing append-only session logs, in one batch or as a stream.

A log may only grow: an entry that comes before what was seen, a second entry of the same place or id, or a parent that does
not come before its child is a violation that is counted against its session; a stream never merges it, as a watermark would.
Batches of whole logs are compared with what was seen before; a stream carries only what is new and compares nothing again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import history

SCHEMA = "session_id long, entries long, last_ord long, leaf_id long, violations long"


def observe_batch(entries: DataFrame) -> DataFrame:
    """session_id, entries, last_ord, leaf_id, violations of complete logs (session_id, entry_id, parent_id, ord)."""
    gap = F.col("ord") != F.row_number().over(Window.partitionBy("session_id").orderBy("ord", "entry_id")) - 1
    found = entries.withColumn("gap", gap).groupBy("session_id").agg(
        F.count("*").alias("entries"), F.max("ord").cast("long").alias("last_ord"), F.max_by("entry_id", "ord").alias("leaf_id"), F.count_if("gap").alias("gaps")
    )
    broken = history.violations(entries).groupBy("session_id").agg(F.count("*").alias("broken"))
    violations = (F.col("gaps") + F.coalesce("broken", F.lit(0))).cast("long").alias("violations")
    return found.join(broken, "session_id", "left").select("session_id", "entries", "last_ord", "leaf_id", violations)


def reobserve(before: DataFrame, now: DataFrame) -> DataFrame:
    """session_id, outcome, added: how logs (session_id, entry_id, parent_id, ord, type) that were seen before are to be read again.

    A log whose seen part is still its beginning, entry by entry, is unchanged or appended (only the added entries are new); one that is
    not, or that breaks a rule itself, is read again as a whole; one that was not seen is new, and one that is no more is gone.
    """
    what = F.struct("entry_id", "parent_id", "type")
    old = before.select("session_id", "ord", what.alias("was"))
    new = now.select("session_id", "ord", what.alias("is"))
    both = old.join(new, ["session_id", "ord"], "full_outer")
    per = both.groupBy("session_id").agg(
        F.count("was").alias("seen"), F.count("is").alias("there"), F.count_if(F.col("was").isNotNull() & ~F.col("was").eqNullSafe(F.col("is"))).alias("other"), F.max(F.when(F.col("was").isNotNull(), F.col("ord"))).alias("last"),
        F.min(F.when(F.col("was").isNull(), F.col("ord"))).alias("first_new"),
    )
    broken = history.violations(now).select("session_id").distinct().withColumn("broken", F.lit(True))
    met = per.join(broken, "session_id", "left")
    diverged = (F.col("other") > 0) | (F.col("first_new") < F.col("last")) | F.col("broken").isNotNull()
    outcome = F.when(F.col("there") == 0, "gone").when(F.col("seen") == 0, "new").when(F.coalesce(diverged, F.lit(False)), "re-read").when(F.col("there") > F.col("seen"), "appended").otherwise("unchanged")
    added = F.when(outcome == "appended", F.col("there") - F.col("seen")).when(outcome.isin("new", "re-read"), F.col("there")).otherwise(0)
    return met.select("session_id", outcome.alias("outcome"), added.cast("long").alias("added"))


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    entries, last, leaf, bad, ids = state.get if state.exists else (0, -1, -1, 0, [])
    seen = dict.fromkeys(map(int, ids))
    rows = pd.concat(list(frames)).sort_values(["ord", "entry_id"])
    for r in rows.itertuples(index=False):
        if r.ord == last + 1 and r.entry_id not in seen and (pd.isna(r.parent_id) or int(r.parent_id) in seen):
            seen[int(r.entry_id)] = None
            entries, last, leaf = entries + 1, int(r.ord), int(r.entry_id)
        else:
            bad += 1
    state.update((entries, last, leaf, bad, list(seen)))
    yield pd.DataFrame([(key[0], entries, last, leaf, bad)], columns=["session_id", "entries", "last_ord", "leaf_id", "violations"])


def observe_stream(entries: DataFrame) -> DataFrame:
    """The same of a stream: after each micro-batch, the sessions that grew, with what is known of them by then.

    The state of a session is four numbers and the ids of its log, which tell whether a parent is known.
    """
    return entries.groupBy("session_id").applyInPandasWithState(_advance, SCHEMA, "entries long, last_ord long, leaf_id long, violations long, ids array<long>", "update", GroupStateTimeout.NoTimeout)


def capture_stream(events: DataFrame, commit, checkpoint: str):
    """Start a query that hands each micro-batch to commit(batch, number), one at a time: a single writer."""
    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(commit).start()
