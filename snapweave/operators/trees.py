"""Stored trees: what they hold, upgrades between their formats, maps walked by joins, and agreement with a scope.

The documents and rules of the formats are those of formats.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import paths
from ..functions.tables import written
from . import formats

MAXIMUM_TRIES = 8


def _canonical(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else json.dumps(json.loads(x), ensure_ascii=False, separators=(",", ":")) + "\n")


def canonical_json(text: Column) -> Column:
    """A JSON text in its shortest spelling, keys in their order, with a line feed."""
    return F.pandas_udf(_canonical, StringType())(text)


def canonical_base64(text: Column) -> Column:
    """The bytes of a base64 text, or null where its spelling is not the one that the bytes have."""
    data = F.try_to_binary(text, F.lit("base64"))
    return F.when(F.regexp_replace(F.base64(data), "\\s", "") == text, data)


def display_path(path: Column) -> Column:
    """A path as a terminal may show it: control characters, quotes and back slashes escaped, and quoted where that or an edge of
    white space makes it needful."""
    shown = F.pandas_udf(_display, StringType())
    return F.when(path.rlike(r'^[!#-\[\]-~]([ !#-\[\]-~]*[!#-\[\]-~])?$'), path).otherwise(shown(path))


def _display(values: pd.Series) -> pd.Series:
    import unicodedata

    def one(path: str | None) -> str | None:
        if path is None:
            return None
        out = []
        for c in path:
            hidden = unicodedata.category(c) in ("Cc", "Cf", "Cs", "Zl", "Zp")
            out.append(f"\\u{{{ord(c):x}}}" if hidden else "\\" + c if c in '\\"' else c)
        text = "".join(out)
        return f'"{text}"' if text != path or not path or path.strip() != path else text

    return values.map(one)


def source_is_relevant(path: Column, prefix: Column) -> Column:
    """Whether an ignore file of the repository can bear on what lies below prefix: it is at, above or below it."""
    is_source = (path == ".gitignore") | path.endswith("/.gitignore")
    base = F.when(path == ".gitignore", "").otherwise(F.regexp_replace(path, "/\\.gitignore$", ""))
    slash = F.lit("/")
    return is_source & ((base == prefix) | (base == "") | (prefix == "") | prefix.startswith(F.concat(base, slash)) | base.startswith(F.concat(prefix, slash)))


def scope_problems(sources: DataFrame, most: int = 65_536, most_bytes: int = 64 << 20) -> DataFrame:
    """rule, scope, path of archived ignore sources (scope, path, contents as base64): given twice under one key, not canonical, not
    relevant, or beyond the number or bytes of a scope (path null)."""
    rows = sources.withColumn("data", canonical_base64(F.col("contents"))).withColumn("key", paths.portable_key(F.col("path")))
    coded = rows.filter("data is null").select(F.lit("not-canonical").alias("rule"), "scope", "path")
    other = rows.filter(paths.basename(F.col("path")) != ".gitignore").select(F.lit("not-a-source").alias("rule"), "scope", "path")
    twice = rows.groupBy("scope", "key").agg(F.count("*").alias("n"), F.max("path").alias("path")).filter("n > 1").select(F.lit("duplicate").alias("rule"), "scope", "path")
    sums = rows.groupBy("scope").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("data").cast("long")), F.lit(0)).alias("b"))
    over = sums.filter((F.col("n") > most) | (F.col("b") > most_bytes)).select(F.lit("over-budget").alias("rule"), "scope", F.lit(None).cast("string").alias("path"))
    return coded.unionByName(other).unionByName(twice).unionByName(over)


def scope_agreement(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """rule, path by which a tree disagrees with its scope: entries (path, managed) that the scope excludes, and managed ignore
    sources (path, managed) without an entry."""
    out = entries.filter("not managed").select(F.lit("excluded-entry").alias("rule"), "path")
    have = entries.select(paths.portable_key(F.col("path")).alias("k")).distinct()
    lost = sources.filter("managed").withColumn("k", paths.portable_key(F.col("path"))).join(have, "k", "left_anti")
    return out.unionByName(lost.select(F.lit("missing-source").alias("rule"), "path"))


def read_stored(documents: DataFrame, namespace: str = formats.NAMESPACE) -> DataFrame:
    """oid, format, entries, state of stored documents (oid, document binary): intact, corrupt (another digest, or not the canonical bytes
    of what they say) or unrecognised (no known format). entries counts those inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for oid, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if formats.oid_of(data) != oid:
                        raise formats.Invalid("digest")
                    fmt, entries, _ = formats.parse(data, namespace)
                    rows.append((oid, fmt, len(entries), "intact"))
                except formats.Invalid as e:
                    rows.append((oid, None, None, "unrecognised" if str(e) == "unrecognised" else "corrupt"))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["oid", "format", "entries", "state"])

    return documents.select("oid", "document").mapInArrow(run, "oid string, format int, entries int, state string")


upgrade = formats.upgrades


def upgrade_map(roots: DataFrame, upgraded: DataFrame) -> DataFrame:
    """old_oid, new_oid for all roots (tree_oid). All or nothing: a root without a new oid is an error."""
    both = roots.select(F.col("tree_oid").alias("old_oid")).distinct().join(upgraded.select("old_oid", "new_oid"), "old_oid", "left")
    return both.select("old_oid", F.coalesce("new_oid", F.raise_error(F.concat(F.lit("no upgrade of "), F.col("old_oid"))).cast("string")).alias("new_oid"))


NODE_SHAPE = (
    "level int, entries array<struct<path:string,type:string,blobOid:string,recreationMode:int,targetContentId:string,targetByteLength:long,symlinkKind:string>>, "
    "children array<struct<highKey:string,oid:string,entryCount:long>>"
)


def map_roots(nodes: DataFrame) -> DataFrame:
    """tree, oid, level, entries of the root of each tree's nodes (formats.NODE)."""
    top = nodes.groupBy("tree").agg(F.max_by(F.struct("oid", "level", "entries"), "level").alias("r"))
    return top.select("tree", "r.oid", "r.level", "r.entries")


def tree_roots(nodes: DataFrame, scopes: DataFrame, namespace: str = formats.NAMESPACE) -> DataFrame:
    """tree, root_oid, document for each tree of scopes (tree, scope_oid): what a root document says of its nodes and scope."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, scope, oid, level, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = formats.root_document(None if oid is None else (level, oid), n or 0, scope, namespace)
                rows.append((tree, formats.oid_of(data), data))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], names=["tree", "root_oid", "document"])

    both = scopes.join(map_roots(nodes), "tree", "left").select("tree", "scope_oid", "oid", "level", "entries")
    return both.mapInArrow(run, "tree string, root_oid string, document binary")


def read_map(objects: DataFrame, roots: DataFrame, namespace: str = formats.NAMESPACE) -> tuple[DataFrame, DataFrame]:
    """Entries (tree and formats.STORED) of maps walked from their roots (tree, oid, level), and problems (tree, rule).

    objects: oid, document binary. Each step is a join by oid and one level down; a node must be the bytes of its oid, and have the level,
    the high key and the count that its parent says. The entries are then built into a map again, whose root must be the one that the
    walk began at.
    """
    level = roots.select("tree", "oid", F.col("level").alias("want"), F.lit(None).cast("string").alias("high"), F.lit(None).cast("long").alias("n"))
    entries = problems = None
    for _ in range(formats.MOST_LEVELS):
        met = level.join(objects.select("oid", "document"), "oid", "left").withColumn("d", F.from_json(F.col("document").cast("string"), NODE_SHAPE))
        last = F.coalesce(F.element_at("d.entries", -1)["path"], F.element_at("d.children", -1)["highKey"])
        below = F.coalesce(F.size("d.entries").cast("long"), F.aggregate("d.children", F.lit(0).cast("long"), lambda a, c: a + c["entryCount"]))
        wrong = (
            F.when(F.col("document").isNull(), "missing-node").when(F.sha2("document", 256) != F.col("oid"), "corrupt").when(~F.col("d.level").eqNullSafe(F.col("want")), "wrong-level")
            .when(last != F.col("high"), "wrong-high-key").when(below != F.col("n"), "wrong-count")
        )
        met = written(met.withColumn("rule", wrong).drop("document"), "walk")
        bad = met.filter("rule is not null").select("tree", "rule")
        good = met.filter("rule is null")
        leaves = good.select("tree", F.explode("d.entries").alias("e")).select("tree", "e.path", "e.type", F.col("e.blobOid").alias("blob_oid"), F.col("e.recreationMode").alias("mode"), F.col("e.targetContentId").alias("target_id"), F.col("e.targetByteLength").alias("target_bytes"), F.col("e.symlinkKind").alias("symlink_kind"))
        entries, problems = (leaves, bad) if entries is None else (entries.unionByName(leaves), problems.unionByName(bad))
        level = good.select("tree", (F.col("d.level") - 1).alias("want"), F.explode("d.children").alias("c")).select("tree", "c.oid", "want", F.col("c.highKey").alias("high"), F.col("c.entryCount").alias("n"))
        if level.isEmpty():
            break
    built = map_roots(formats.map_nodes(entries, namespace)).select("tree", F.col("oid").alias("built"))
    other = roots.join(built, "tree", "left").filter(~F.col("oid").eqNullSafe(F.col("built"))).select("tree", F.lit("not-rebuilt").alias("rule"))
    return entries, problems.unionByName(other)


def publish_tree(nodes: DataFrame, store: DataFrame) -> DataFrame:
    """What publishing maps must write, dependencies first: new nodes (of formats.NODE), each once, with their order (the level)."""
    return nodes.dropDuplicates(["oid"]).join(store.select("oid"), "oid", "left_anti").select("oid", "document", F.col("level").alias("step"))


def migrate(read_version, read_roots, steps: dict, current: int, tries: int = MAXIMUM_TRIES) -> int:
    """Run the steps (version to a pair: prepare(roots), apply(prepared)) from the stored version to ``current``, one at a time.

    A step is applied only if the roots are the same after it was prepared as before; otherwise it is prepared again, ``tries``
    times at most. Returns the number of steps applied.
    """
    done = 0
    while (version := read_version()) < current:
        prepare, apply = steps[version]
        for _ in range(tries):
            before = written(read_roots().distinct(), "roots")
            prepared = prepare(before)
            after = read_roots().distinct()
            if before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty():
                apply(prepared)
                break
        else:
            raise RuntimeError(f"the roots did not hold still in {tries} tries")
        if read_version() <= version:
            raise RuntimeError("a migration step did not raise the version")
        done += 1
    return done
