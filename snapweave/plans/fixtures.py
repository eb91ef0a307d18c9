"""Projections of the public test tables to workspaces, session graphs, slots and packs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark, d: str, where: str, oid: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(where)
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.lit("regular").alias("kind"), F.expr(oid).alias("oid"), F.lit(None).cast("string").alias("target"))


def saved(spark, d: str) -> DataFrame:
    return _files(spark, d, "doc_id % 19 <> 7", "sha2(text, 256)").drop("doc_id")


def current(spark, d: str) -> DataFrame:
    return _files(spark, d, "doc_id % 17 <> 3", "case when doc_id % 13 = 5 then sha2(concat(text, '#edit'), 256) else sha2(text, 256) end").drop("doc_id")


def respelled(spark, d: str) -> DataFrame:
    """current(), with some directories in other letters."""
    parts = F.split("path", "/")
    first, second = F.element_at(parts, 1), F.element_at(parts, 2)
    odd = F.concat_ws("/", F.when(F.col("path") < F.lit("n"), F.upper(first)).otherwise(first), F.when(second == "de", "DE").otherwise(second), F.element_at(parts, 3))
    return current(spark, d).withColumn("path", odd)


def excluded(spark, d: str, remainder: int = 9) -> DataFrame:
    some = _files(spark, d, "true", "null").select(F.when(F.col("doc_id") % 23 == remainder, F.col("path")).otherwise(F.concat(F.lit("ignored/"), "path")).alias("path"), "kind")
    return some.unionByName(table(spark, d, "documents").select(F.col("source").alias("path"), F.lit("directory").alias("kind")).distinct())


def entries(spark, d: str) -> DataFrame:
    e = table(spark, d, "events")
    e = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("entry_id"), "event_type", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("ord"))
    up = e.select("session_id", F.col("ord").alias("parent_ord"), F.col("entry_id").alias("parent_id"))
    kind = F.expr("case event_type when 'error' then 'label' when 'purchase' then 'compaction' when 'view' then 'custom_message' else 'message' end")
    role = F.expr("case event_type when 'signup' then 'user' when 'click' then 'assistant' end")
    e = e.withColumn("parent_ord", F.expr("case when ord = 0 then null when ord % 7 = 0 then ord div 2 else ord - 1 end"))
    return e.join(up, ["session_id", "parent_ord"], "left").select("session_id", "entry_id", "parent_id", "ord", kind.alias("type"), role.alias("role"))


def slots(spark, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("entry_id"), "event_type")
    e = e.filter("event_type = 'purchase' or (event_type = 'click' and entry_id % 11 = 0) or (event_type = 'signup' and entry_id % 5 = 0)")
    oid = F.expr("case when event_type <> 'signup' then sha2(cast(entry_id as string), 256) end")
    return e.select("session_id", "entry_id", oid.alias("tree_oid"), F.expr("case when event_type = 'purchase' then 'open' else 'blocked' end").alias("capture_state"))


def pack_entries(spark, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min(F.col("l_quantity").cast("long")).alias("q"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size").cast("long") * 1024).alias("decoded_length"))
    return rows.join(part, "l_partkey").select(
        F.expr("sha2(concat('pack-', l_suppkey), 256)").alias("pack_id"),
        F.expr("sha2(concat('blob-', l_partkey, '-', l_suppkey % 6), 256)").alias("logical_id"),
        F.lit("content").alias("kind"),
        F.expr("q * 64 * (case l_suppkey % 4 when 0 then 1 when 1 then 2 when 2 then 4 else 8 end)").alias("length"),
        "decoded_length",
        F.expr("l_partkey % 5 > l_suppkey % 6 - 1").alias("alive"),
    )


def live(spark, d: str) -> DataFrame:
    return pack_entries(spark, d).filter("alive").select("kind", "logical_id").distinct()


def edges(spark, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.select(F.expr("sha2(concat('tree-', l_orderkey), 256)").alias("tree_id"), F.expr("sha2(concat('blob-', l_partkey, '-', l_suppkey % 6), 256)").alias("blob_id"), F.col("l_suppkey").alias("path"))


#: The same in SQL, by name; each may use those before it.
SQL = {
    "saved": "select source || '/' || lang || '/' || doc_id || '.txt' as path, sha256(text) as oid from documents where doc_id % 19 <> 7",
    "current": "select source || '/' || lang || '/' || doc_id || '.txt' as path, case when doc_id % 13 = 5 then sha256(text || '#edit') else sha256(text) end as oid from documents where doc_id % 17 <> 3",
    "excluded": "select case when doc_id % 23 = 9 then '' else 'ignored/' end || source || '/' || lang || '/' || doc_id || '.txt' as path, 'regular' as kind from documents union select distinct source, 'directory' from documents",
    "expected": "select case when doc_id % 23 = 10 then '' else 'ignored/' end || source || '/' || lang || '/' || doc_id || '.txt' as path, 'regular' as kind from documents union select distinct source, 'directory' from documents",
    "respelled": """select case when path < 'n' then upper(string_split(path, '/')[1]) else string_split(path, '/')[1] end || '/' || case when string_split(path, '/')[2] = 'de' then 'DE' else string_split(path, '/')[2] end
        || '/' || string_split(path, '/')[3] as path, oid from current""",
    "numbered": "select user_id as session_id, event_id as entry_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as ord from events",
    "entry": """select a.session_id, a.entry_id, b.entry_id as parent_id, a.ord, a.event_type,
        case a.event_type when 'error' then 'label' when 'purchase' then 'compaction' when 'view' then 'custom_message' else 'message' end as type
        from numbered a left join numbered b on a.session_id = b.session_id and b.ord = case when a.ord = 0 then null when a.ord % 7 = 0 then a.ord // 2 else a.ord - 1 end""",
    "slot": """select user_id as session_id, event_id as entry_id, case when event_type <> 'signup' then sha256(cast(event_id as varchar)) end as tree_oid,
        case when event_type = 'purchase' then 'open' else 'blocked' end as capture_state from events
        where event_type = 'purchase' or (event_type = 'click' and event_id % 11 = 0) or (event_type = 'signup' and event_id % 5 = 0)""",
    "pack_entry": """select sha256('pack-' || l_suppkey) as pack_id, sha256('blob-' || l_partkey || '-' || (l_suppkey % 6)) as logical_id, 'content' as kind,
        min(cast(l_quantity as bigint)) * 64 * (case l_suppkey % 4 when 0 then 1 when 1 then 2 when 2 then 4 else 8 end) as length, max(cast(p_size as bigint)) * 1024 as decoded_length,
        l_partkey % 5 > l_suppkey % 6 - 1 as alive from lineitem join part on p_partkey = l_partkey group by l_suppkey, l_partkey""",
    "edge": "select sha256('tree-' || l_orderkey) as tree_id, sha256('blob-' || l_partkey || '-' || (l_suppkey % 6)) as blob_id, l_suppkey as path from lineitem",
    "landing": "select session_id, entry_id, case when type <> 'label' then entry_id end as landing_id, case when type = 'label' then parent_id end as at from entry union all select l.session_id, l.entry_id, case when e.type <> 'label' then e.entry_id end, case when e.type = 'label' then e.parent_id end from landing l join entry e on e.session_id = l.session_id and e.entry_id = l.at where l.landing_id is null",
    # the nearest ancestor that isn't a label, for each entry that isn't one
    "up": "select session_id, entry_id, parent_id as at from entry where type <> 'label' union all select u.session_id, u.entry_id, e.parent_id from up u join entry e on e.session_id = u.session_id and e.entry_id = u.at and e.type = 'label'",
    "graph": "select u.session_id, u.entry_id, u.at as stable_parent_id, n.ord from up u join entry n on n.session_id = u.session_id and n.entry_id = u.entry_id left join entry e on e.session_id = u.session_id and e.entry_id = u.at where e.type is null or e.type <> 'label'",
    "closure": "select session_id, entry_id, entry_id as ancestor_id, cast(0 as bigint) as depth from graph union all select c.session_id, c.entry_id, g.stable_parent_id, c.depth + 1 from closure c join graph g on g.session_id = c.session_id and g.entry_id = c.ancestor_id where g.stable_parent_id is not null",
    "nearest": "select c.session_id, c.entry_id, arg_min(c.ancestor_id, c.depth) filter (s.tree_oid is not null) as found_at, arg_min(s.tree_oid, c.depth) filter (s.tree_oid is not null) as tree_oid from closure c left join slot s on s.session_id = c.session_id and s.entry_id = c.ancestor_id group by all",
}
NEEDS = {"respelled": ["current"], "entry": ["numbered"], "landing": ["entry"], "up": ["entry"], "graph": ["up", "entry"], "closure": ["graph"], "nearest": ["closure", "slot"]}


def sql(body: str, *names: str) -> str:
    """body, after the definitions of the named projections and what they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for x in NEEDS.get(n, []):
            add(x)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "with recursive " + ",\n".join(f"{n} as ({SQL[n]})" for n in order) + "\n" + body
