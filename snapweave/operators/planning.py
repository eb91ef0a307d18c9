"""Planners whose next step depends on the last, each over one bounded, independent group, and checks of indexes and scopes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.tables import written
from .chunks import delta_bytes, simple_delta

#: Fixed values of the planners.
MAX_RECORDS = 65_535
MAX_ANCHORS, CANDIDATES = 8, 4
DELTA_SAVING, DELTA_SAVING_PERCENT, NEAR_PERCENT = 128, 35, 25


def batches(records: DataFrame, target: int, most: int = MAX_RECORDS) -> DataFrame:
    """class, key, batch: records (class, key, length) in order of key, a new batch where the next would pass target or ``most``
    records. A record above target is a batch of its own. A pass is bounded by its budget, so a class is one group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        batch, size, count, out = 0, 0, 0, []
        for r in rows.sort_values("key").itertuples(index=False):
            if count and (size + r.length > target or count == most):
                batch, size, count = batch + 1, 0, 0
            out.append((r[0], r.key, batch))
            size, count = size + r.length, count + 1
        return pd.DataFrame(out, columns=["class", "key", "batch"])

    return records.select("class", "key", "length").groupBy("class").applyInPandas(run, "class string, key string, batch long")


def _useful(base: bytes, target: bytes) -> bool:
    steps = simple_delta(base, target)
    saved = len(target) - delta_bytes(steps) if steps else 0
    return saved >= DELTA_SAVING and saved * 100 >= len(target) * DELTA_SAVING_PERCENT


def anchors(contents: DataFrame) -> DataFrame:
    """path, content_id of the anchors among ranked contents (path, content_id, rank, n, content): in order of rank, a content
    becomes one if no nearby anchor before it saves enough, up to eight a path. A path has as many contents as were ranked."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for r in rows.sort_values("rank").itertuples(index=False):
            size = len(r.content)
            near = [a for a in kept if abs(size - len(a.content)) * 100 <= max(size, len(a.content)) * NEAR_PERCENT]
            near.sort(key=lambda a: (abs(size - len(a.content)), -a.n, len(a.content), a.content_id))
            if len(kept) < MAX_ANCHORS and not any(_useful(a.content, r.content) for a in near[:CANDIDATES]):
                kept.append(r)
        return pd.DataFrame([(a.path, a.content_id) for a in kept], columns=["path", "content_id"])

    return contents.select("path", "content_id", "rank", "n", "content").groupBy("path").applyInPandas(run, "path string, content_id string")


def proven(source: DataFrame, fork: DataFrame) -> DataFrame:
    """session_id, entry_id: coordinates of fork (session_id, source_session, entry_id, stable_parent_id, ord) that its source has
    too, in the same order, under the same parent, and with that parent proven as well."""
    s = source.select(F.col("session_id").alias("source_session"), "entry_id", F.col("stable_parent_id").alias("p"), F.col("ord").alias("o"))
    both = fork.join(s, ["source_session", "entry_id"], "left")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        seen, last, out = set(), -1, []
        for r in rows.sort_values("ord").itertuples(index=False):
            parent, there = (None if pd.isna(x) else x for x in (r.stable_parent_id, r.p))
            if not pd.isna(r.o) and r.o > last and parent == there and (parent is None or parent in seen):
                seen.add(r.entry_id)
                last = r.o
                out.append((r.session_id, r.entry_id))
        return pd.DataFrame(out, columns=["session_id", "entry_id"])

    return both.select("session_id", "entry_id", "stable_parent_id", "ord", "p", "o").groupBy("session_id").applyInPandas(run, "session_id long, entry_id long")


def index_differences(cached: DataFrame, footers: DataFrame) -> DataFrame:
    """side and the entry by which a cached index and the packs' footers differ; empty if the index is current."""
    a = cached.exceptAll(footers).withColumn("side", F.lit("cached"))
    return a.unionByName(footers.exceptAll(cached).withColumn("side", F.lit("footers")))


def delta_chain(entries: DataFrame) -> DataFrame:
    """pack_id, logical_id, base_id of delta records (pack_id, ordinal, logical_id, back): the record ``back`` places before in the
    same pack; null where that place doesn't exist."""
    base = entries.select("pack_id", F.col("ordinal").alias("at"), F.col("logical_id").alias("base_id"))
    asked = entries.filter("back is not null").withColumn("at", F.col("ordinal") - F.col("back"))
    return asked.join(base, ["pack_id", "at"], "left").select("pack_id", "logical_id", "base_id")


def scope_bindings(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """rule, path: ignore files (path, oid) among entries that the scope's archive (path, oid) lacks or holds otherwise, and archived
    ones without an entry."""
    files = entries.filter(paths.basename(F.lower("path")) == ".gitignore").select(paths.portable_key(F.col("path")).alias("k"), "path", "oid")
    kept = sources.select(paths.portable_key(F.col("path")).alias("k"), F.col("path").alias("p"), F.col("oid").alias("o"))
    both = files.join(kept, "k", "full_outer")
    rule = F.when(F.col("p").isNull(), "not-archived").when(F.col("path").isNull(), "not-managed").when(F.col("oid") != F.col("o"), "other-content")
    return both.select(rule.alias("rule"), F.coalesce("path", "p").alias("path")).filter("rule is not null")


def at_most(df: DataFrame, most: int) -> DataFrame:
    """df, which must not have more than ``most`` rows: one row more is looked for, and is an error."""
    over = df.limit(most + 1).groupBy().agg(F.count("*").alias("n"))
    checked = over.select(F.assert_true(F.col("n") <= most, F.lit(f"more than {most} rows")).alias("ok"))
    return df.join(F.broadcast(checked), F.col("ok").isNull()).drop("ok")


def roots(slots: DataFrame, most: int | None = None) -> DataFrame:
    """tree_oid of all slots that have one, each once, in order; more than ``most`` are an error."""
    found = slots.filter("tree_oid is not null").select("tree_oid").distinct()
    return (found if most is None else at_most(found, most)).orderBy("tree_oid")


def root_pages(slots: DataFrame, most: int) -> DataFrame:
    """page, tree_oid of all slots that have one, each once: page 0 has the first ``most`` in order, and what is over is on the pages
    after it, each as large but the last. Roots are numbered in ranges, so no task holds them all."""
    if most < 1:
        raise ValueError("a page has a root at least")
    ranges = written(slots.filter("tree_oid is not null").select("tree_oid").distinct().repartitionByRange("tree_oid").withColumn("part", F.spark_partition_id()), "roots")
    sizes = ranges.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return ranges.join(F.broadcast(before), "part").select(F.expr(f"(before + row_number() over (partition by part order by tree_oid) - 1) div {most}").alias("page"), "tree_oid")


def policy_budget(changes: DataFrame, most_sources: int = 100_000, most_bytes: int = 16 << 20) -> DataFrame:
    """scope, sources, bytes, first_over of ignore sources that were set one after another (scope, seq, path, bytes): a path's later
    bytes replace its earlier ones. first_over is the first seq at which the number or the sum passed its limit, or null."""
    along, own = Window.partitionBy("scope").orderBy("seq"), Window.partitionBy("scope", "path").orderBy("seq")
    before = F.lag("bytes").over(own)
    step = changes.withColumn("more", F.col("bytes") - F.coalesce(before, F.lit(0))).withColumn("new", before.isNull().cast("long"))
    run = step.select("scope", "seq", F.sum("more").over(along).alias("b"), F.sum("new").over(along).alias("n"))
    over = (F.col("b") > most_bytes) | (F.col("n") > most_sources)
    return run.groupBy("scope").agg(F.max_by("n", "seq").alias("sources"), F.max_by("b", "seq").alias("bytes"), F.min(F.when(over, F.col("seq"))).alias("first_over"))


def replay_risk(recorded: Column, now: Column) -> Column:
    """Whether a scope's recorded evaluator version can be trusted to judge as the present one."""
    return F.when(recorded.isNull(), "legacy-unattested").when(recorded != now, "version-mismatch").otherwise("none")


def overlay(defaults: DataFrame, *layers: DataFrame) -> DataFrame:
    """name, value: settings of defaults, overridden by each layer (name, value) in turn; unknown names are dropped."""
    out = defaults.select("name", "value")
    for x in layers:
        out = out.join(x.select("name", F.col("value").alias("v")), "name", "left").select("name", F.coalesce("v", "value").alias("value"))
    return out


def flatten_recipes(roots: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """content_id, ord, chunk_id: the chunks under roots (content_id, node_id) in order. edges have parent_id, ord, child_id and kind
    (node or chunk); a recipe is no deeper than ``most`` levels, so a cycle ends as an error there."""
    level = roots.select("content_id", "node_id", F.array().cast("array<long>").alias("way"))
    out = None
    for _ in range(most + 1):
        step = level.join(edges, level.node_id == edges.parent_id).select("content_id", "child_id", "kind", F.array_append("way", F.col("ord").cast("long")).alias("way"))
        leaves = step.filter("kind = 'chunk'").select("content_id", "way", F.col("child_id").alias("chunk_id"))
        out = leaves if out is None else out.unionByName(leaves)
        level = step.filter("kind = 'node'").select("content_id", F.col("child_id").alias("node_id"), "way")
        if level.isEmpty():
            ranked = out.groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct("way", "chunk_id"))).alias("c"))
            return ranked.select("content_id", F.posexplode("c").alias("ord", "c")).select("content_id", "ord", "c.chunk_id")
    raise ValueError("a recipe is too deep, or loops")
