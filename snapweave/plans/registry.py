"""Every registered query over the library's operators, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.tables import new_folder, written
from ..operators import chunks, compaction, drift, formats, history, manifest, metadata, planning, sessions, slots, storage, trees
from ..sources import listing, objects, packfile, scan
from ..streaming import observer
from . import fixtures as fx

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(body: str | None = None, *names: str) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if body is not None:
            ORACLES[f.__name__] = fx.sql(body, *names) if names else body
        return f

    return put


# drift


@query(
    """select case when s.path is null then 'deleted' when c.path is null then 'created' else 'modified' end as action, coalesce(s.path, c.path) as path
    from current c full join saved s on s.path = c.path where s.oid is distinct from c.oid or s.path is null or c.path is null""",
    "saved", "current",
)
def diff_actions(spark, d):
    return drift.actions(fx.current(spark, d), fx.saved(spark, d))


@query("select distinct s.oid as blob_oid from saved s left join current c on s.path = c.path where c.path is null or c.oid is distinct from s.oid", "saved", "current")
def diff_required_blobs(spark, d):
    return drift.required_blobs(fx.current(spark, d), fx.saved(spark, d))


BLOCKERS = """select path, target_path from (
    select x.path, coalesce((select s.path from saved s where x.path = s.path or starts_with(x.path, s.path || '/') order by length(s.path) desc limit 1),
        case when exists (select 1 from saved s where starts_with(s.path, x.path || '/')) then x.path end) as target_path from excluded x) where target_path is not null"""


@query(BLOCKERS, "saved", "excluded")
def diff_scope_blockers(spark, d):
    return drift.scope_blockers(fx.excluded(spark, d), fx.saved(spark, d))


@query("select coalesce(a.path, b.path) as path from excluded a full join expected b on a.path = b.path where a.kind is distinct from b.kind", "excluded", "expected")
def diff_occupancy_changed(spark, d):
    return drift.occupancy_changed(fx.excluded(spark, d), fx.excluded(spark, d, 10))


DIRS = "select distinct list_aggregate(string_split(path, '/')[1:i], 'string_agg', '/') as path from (select path, unnest(range(1, len(string_split(path, '/')))) as i from {0})"
PLAN = "select case when s.path is null then 'deleted' when c.path is null then 'created' else 'modified' end as action, coalesce(s.path, c.path) as path from current c full join saved s on s.path = c.path where s.oid is distinct from c.oid"


@query(
    f"""select 1 as step, 0 as depth, path from ({PLAN}) where action = 'deleted'
    union all select 2, -len(string_split(path, '/')), path from ({DIRS.format('current')} except {DIRS.format('saved')})
    union all select 3, len(string_split(path, '/')), path from ({DIRS.format('saved')} except {DIRS.format('current')})
    union all select 4, 0, path from ({PLAN}) where action <> 'deleted'""",
    "saved", "current",
)
def diff_apply_order(spark, d):
    return drift.apply_order(fx.current(spark, d), fx.saved(spark, d)).select("step", F.col("depth").cast("long").alias("depth"), "path")


@query(
    """select count(*) filter (c.path is null) as created, count(*) filter (s.path is null) as deleted, count(*) filter (s.oid <> c.oid) as modified, count(*) filter (s.oid = c.oid) as unchanged,
    cast(0 as bigint) as renamed, count(*) filter (s.oid is distinct from c.oid) as actions, count(*) filter (s.oid is distinct from c.oid) > 0 as has_changes from current c full join saved s on s.path = c.path""",
    "saved", "current",
)
def diff_summary(spark, d):
    return drift.summary(fx.current(spark, d), fx.saved(spark, d))


RENAMES = f"""select min(h.path) as from_path, w.path as path from ({DIRS.format('saved')}) w join ({DIRS.format('respelled')}) h on lower(w.path) = lower(h.path) and string_split(w.path, '/')[-1] <> string_split(h.path, '/')[-1]
    where w.path not in ({DIRS.format('respelled')}) group by w.path"""


@query(RENAMES, "saved", "respelled")
def diff_renames(spark, d):
    return drift.renames(fx.respelled(spark, d), fx.saved(spark, d))


@query(
    f"""select r, row_number() over (partition by r order by path) as ord, case r when 0 then '- ' || path when 1 then '~ ' || path when 2 then '> ' || from_path || ' \u2192 ' || path else '+ ' || path end as line
    from (select case action when 'deleted' then 0 when 'modified' then 1 else 3 end as r, path, null as from_path from ({PLAN.replace('from current', 'from respelled')}) union all select 2, path, from_path from ({RENAMES}))""",
    "saved", "respelled",
)
def diff_preview(spark, d):
    return drift.preview(fx.respelled(spark, d), fx.saved(spark, d)).select(F.col("r").cast("long").alias("r"), F.col("ord").cast("long").alias("ord"), "line")


@query(
    """select w.path, h.path as current_path, 'spelling' as by from saved w join respelled h on lower(w.path) = lower(h.path) where w.path not in (select path from respelled)
    union all select w.path, h.path, 'identity' from saved w join respelled h on w.oid = h.oid where w.path not in (select path from respelled) and lower(w.path) not in (select lower(path) from respelled)""",
    "saved", "respelled",
)
def diff_aliases(spark, d):
    of = lambda df: df.select("path", F.col("oid").alias("identity"))
    return drift.aliases(of(fx.respelled(spark, d)), of(fx.saved(spark, d)))


@query("select path, oid, 'first' as side from (from saved except all from current) union all select path, oid, 'second' from (from current except all from saved)", "saved", "current")
def scan_stability(spark, d):
    return drift.stable(fx.saved(spark, d).select("path", "oid"), fx.current(spark, d).select("path", "oid"))


# paths and manifests

ODD = """concat(case doc_id % 10 when 0 then '/' when 1 then '../' when 2 then 'a//' when 3 then 'x/.Git/' when 4 then 'A/' when 5 then 'a/' else source || '/' end, cast(doc_id % 40 as {0}), case when doc_id % 8 = 5 then '/sub' else '' end)"""


def odd_paths(spark, d):
    return fx.table(spark, d, "documents").select(F.expr(ODD.format("string").replace("source || '/'", "concat(source, '/')")).alias("path"))


@query(
    f"""with p as (select {ODD.format('varchar')} as path from documents), one as (select distinct path from p)
    select distinct case when starts_with(path, '/') then 'absolute' when list_has_any(string_split(path, '/'), ['', '.', '..']) then 'unsafe-component' else 'git-component' end as rule, path from p
      where starts_with(path, '/') or list_has_any(string_split(path, '/'), ['', '.', '..']) or list_contains(string_split(lower(path), '/'), '.git')
    union all select 'duplicate-path', path from p group by path having count(*) > 1
    union all select 'portable-alias', path from (select path, min(path) over (partition by lower(path)) as first from one) where path <> first
    union all select distinct 'managed-parent', a.path from one a join one b on starts_with(a.path, b.path || '/')"""
)
def manifest_violations(spark, d):
    return manifest.violations(odd_paths(spark, d))


@query("select oid as blob_oid, min(path) as first_path from saved group by oid", "saved")
def manifest_distinct_blobs(spark, d):
    return manifest.distinct_blobs(fx.saved(spark, d))


@query("select distinct oid from saved where oid not in (select oid from current)", "saved", "current")
def publish_new_blobs(spark, d):
    return manifest.new_blobs(fx.saved(spark, d), fx.current(spark, d).select("oid"))


@query("select tree_id, cast(sum(length) as bigint) as bytes, sum(length) > 20000 as over_quota from edge join (select logical_id, min(length) as length from pack_entry group by all) on logical_id = blob_id group by tree_id", "edge", "pack_entry")
def snapshot_bytes(spark, d):
    sizes = fx.pack_entries(spark, d).groupBy(F.col("logical_id").alias("blob_id")).agg(F.min("length").alias("length"))
    return manifest.snapshot_bytes(fx.edges(spark, d).select("tree_id", "blob_id"), sizes, 20000)


@query(
    """select path, len(string_split(path, '/')) as depth, string_split(path, '/')[-1] as base, source || '/' || lang as parent, path[length(source) + 2:] as local, sha256(path)[1:2] || '/' || sha256(path)[3:] as object_path
    from (select source, lang, source || '/' || lang || '/' || doc_id || '.txt' as path from documents)"""
)
def path_functions(spark, d):
    rows = fx.table(spark, d, "documents").select("source", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    p = F.col("path")
    return rows.select("path", paths.depth(p).cast("long").alias("depth"), paths.basename(p).alias("base"), F.element_at(paths.ancestors(p), -1).alias("parent"), paths.local_path(p, F.col("source")).alias("local"), paths.object_path(F.sha2(p, 256)).alias("object_path"))


@query(f"select path, count(*) as entries from (select list_aggregate(string_split(path, '/')[1:i], 'string_agg', '/') as path from (select path, unnest(range(1, len(string_split(path, '/')))) as i from saved)) group by path", "saved")
def path_directories(spark, d):
    return fx.saved(spark, d).select(F.explode(paths.ancestors(F.col("path"))).alias("path")).groupBy("path").agg(F.count("*").alias("entries"))


# session graphs


@query(
    """select session_id, entry_id, case when type = 'label' then 'transparent' else 'stable' end as coordinate,
    case when type = 'custom_message' or event_type = 'signup' then parent_id else entry_id end as landing, type = 'branch_summary' as summary from entry""",
    "entry",
)
def entry_projection(spark, d):
    return history.projection(fx.entries(spark, d))


def graph(spark, d) -> DataFrame:
    """The stable graph of all sessions, written once, since most queries read it several times."""
    return written(history.stable_graph(fx.entries(spark, d)), "graph")


@query("select session_id, entry_id, stable_parent_id, ord from graph", "graph")
def stable_graph(spark, d):
    return graph(spark, d)


@query("select session_id, entry_id, ancestor_id, depth from closure", "closure")
def stable_ancestry(spark, d):
    return history.ancestry(graph(spark, d))


BROKEN = """select session_id, entry_id, ord, type, case when entry_id % 97 = 0 then entry_id + 100000000 when entry_id % 89 = 0 then entry_id else parent_id end as parent_id from entry
    union all select session_id, entry_id, ord, type, parent_id from entry where entry_id % 101 = 0"""


@query(
    f"""with b as ({BROKEN}), p as (select session_id, entry_id as parent_id, min(ord) as parent_ord from b group by all)
    select 'duplicate' as rule, session_id, entry_id from b group by all having count(*) > 1
    union all select distinct case when p.parent_ord is null then 'unknown-parent' else 'forward-parent' end, b.session_id, b.entry_id from b left join p using (session_id, parent_id)
      where b.parent_id is not null and (p.parent_ord is null or p.parent_ord >= b.ord)""".replace("with b", "select * from (with b", 1) + ")",
    "entry",
)
def graph_violations(spark, d):
    e = fx.entries(spark, d)
    parent = F.expr("case when entry_id % 97 = 0 then entry_id + 100000000 when entry_id % 89 = 0 then entry_id else parent_id end")
    return history.violations(e.withColumn("parent_id", parent).unionByName(e.filter("entry_id % 101 = 0")))


RESOLVED = """select n.session_id, n.entry_id, case when s.entry_id is null then found_at end as found_at, case when s.entry_id is null then n.tree_oid end as tree_oid
    from nearest n left join slot s on s.session_id = n.session_id and s.entry_id = n.entry_id and s.tree_oid is null and s.capture_state = 'blocked'"""


@query(RESOLVED, "nearest")
def lineage_resolution(spark, d):
    return history.resolve(graph(spark, d), fx.slots(spark, d))


@query(
    """select case when b.entry_id is null then 'lost' when b.type <> a.type then 'changed' else 'reordered' end as rule, a.session_id, a.entry_id
    from (select e.*, f.ord as o, max(f.ord) over (partition by e.session_id order by e.ord rows between unbounded preceding and 1 preceding) as before
          from entry e left join (select session_id, entry_id, case when entry_id % 37 = 0 then -ord else ord end as ord from entry where entry_id % 41 <> 0) f on f.session_id = e.session_id and f.entry_id = e.entry_id) a
    left join (select session_id, entry_id, case when entry_id % 43 = 0 then 'other' else type end as type from entry where entry_id % 41 <> 0) b on b.session_id = a.session_id and b.entry_id = a.entry_id
    where b.entry_id is null or b.type <> a.type or a.o < a.before""",
    "entry",
)
def graph_extension(spark, d):
    old = fx.entries(spark, d)
    new = old.filter("entry_id % 41 <> 0").withColumn("type", F.expr("case when entry_id % 43 = 0 then 'other' else type end")).withColumn("ord", F.expr("case when entry_id % 37 = 0 then -ord else ord end"))
    return history.extends(old, new)


@query("select session_id, entry_id from (select *, lag(entry_id) over (partition by session_id order by ord) as b from entry) where b is distinct from parent_id", "entry")
def branch_breaks(spark, d):
    return history.branch_breaks(fx.entries(spark, d))


MOVES = "select session_id, lag(entry_id, 2) over (partition by session_id order by ord) as source_id, case when ord % 11 <> 10 then entry_id end as target_id, case when entry_id % 2 = 0 then 'capture' else 'write-protected' end as source_kind from graph"


@query(
    f"""select m.session_id, m.source_id, m.target_id, m.source_kind, case when m.target_id is null then 'no-node' when m.source_id is not distinct from m.target_id then 'same-location'
      when b.entry_id is not null then case when r.tree_oid is not null then 'restore' else 'protected-missing' end
      when m.source_kind = 'capture' and u.depth is not null and coalesce(f.depth, u.depth) >= u.depth then 'inherit-source'
      when r.tree_oid is not null then 'restore' when m.source_kind = 'write-protected' then 'protected-missing' else 'materialize-missing' end as outcome
    from ({MOVES}) m left join closure u on u.session_id = m.session_id and u.entry_id = m.target_id and u.ancestor_id = m.source_id
    left join (select c.session_id, c.entry_id, min(depth) as depth from closure c join slot s on s.session_id = c.session_id and s.entry_id = c.ancestor_id group by all) f on f.session_id = m.session_id and f.entry_id = m.target_id
    left join slot b on b.session_id = m.session_id and b.entry_id = m.target_id and b.capture_state = 'blocked'
    left join ({RESOLVED}) r on r.session_id = m.session_id and r.entry_id = m.target_id""",
    "closure", "nearest",
)
def navigation_outcomes(spark, d):
    g, s = graph(spark, d), fx.slots(spark, d)
    w = Window.partitionBy("session_id").orderBy("ord")
    moves = g.select("session_id", F.lag("entry_id", 2).over(w).alias("source_id"), F.expr("case when ord % 11 <> 10 then entry_id end").alias("target_id"), F.expr("case when entry_id % 2 = 0 then 'capture' else 'write-protected' end").alias("source_kind"))
    return history.navigation(moves, g, s, history.resolve(g, s))


# slots


@query(
    """select g.session_id, g.entry_id, s.tree_oid, s.capture_state, case when s.entry_id is null then 'open-missing' when s.tree_oid is null then 'blocked-missing' else s.capture_state || '-checkpoint' end as slot
    from graph g left join slot s on s.session_id = g.session_id and s.entry_id = g.entry_id""",
    "graph", "slot",
)
def slot_states(spark, d):
    return slots.read(graph(spark, d).select("session_id", "entry_id"), fx.slots(spark, d))


@query(
    """select *, case when outcome = 'applied' and op in ('capture', 'release', 'adopt') then oid when outcome = 'applied' and op = 'block' and before = 'open-missing' then oid else tree_oid end as new_oid,
      case when outcome = 'applied' and op in ('capture', 'release', 'adopt') then 'open' when outcome = 'applied' and op = 'block' then 'blocked' else capture_state end as new_state
      from (select *, case op when 'capture' then case when before like 'blocked%' then 'capture-blocked' else 'applied' end when 'block' then 'applied'
        when 'release' then case when before = 'blocked-checkpoint' and tree_oid = oid then 'applied' else 'checkpoint-mismatch' end else case when before = 'blocked-missing' then 'applied' else 'not-blocked-missing' end end as outcome
        from (select g.session_id, g.entry_id, case g.entry_id % 4 when 0 then 'capture' when 1 then 'block' when 2 then 'release' else 'adopt' end as op, sha256(cast(g.entry_id - g.entry_id % 3 as varchar)) as oid, s.tree_oid, s.capture_state,
          case when s.entry_id is null then 'open-missing' when s.tree_oid is null then 'blocked-missing' else s.capture_state || '-checkpoint' end as before
          from graph g left join slot s on s.session_id = g.session_id and s.entry_id = g.entry_id))""".replace("select *, case when outcome", "select session_id, entry_id, op, before, outcome, case when outcome", 1),
    "graph", "slot",
)
def slot_transitions(spark, d):
    asked = graph(spark, d).select("session_id", "entry_id", F.expr("case entry_id % 4 when 0 then 'capture' when 1 then 'block' when 2 then 'release' else 'adopt' end").alias("op"), F.expr("sha2(cast(entry_id - entry_id % 3 as string), 256)").alias("oid"))
    return slots.transition(asked, fx.slots(spark, d))


@query(
    """select g.session_id, g.entry_id, sha256('new-' || g.entry_id) as oid, case when s.capture_state = 'blocked' then 'blocked' when g.entry_id % 5 = 0 and s.entry_id is not null then 'slot-changed' else 'committed' end as outcome
    from graph g left join slot s on s.session_id = g.session_id and s.entry_id = g.entry_id""",
    "graph", "slot",
)
def capture_commits(spark, d):
    now = fx.slots(spark, d)
    seen = now.filter("entry_id % 5 <> 0").select("session_id", "entry_id", F.col("tree_oid").alias("expected_oid"), F.col("capture_state").alias("expected_state"))
    asked = graph(spark, d).select("session_id", "entry_id", F.expr("sha2(concat('new-', entry_id), 256)").alias("oid"))
    return slots.commit_captures(asked.join(seen, ["session_id", "entry_id"], "left"), now)


LEAF = "select session_id, arg_max(entry_id, ord) as entry_id from graph group by session_id"


@query(
    f"""select coalesce(c.session_id, s.session_id) as session_id, coalesce(c.entry_id, s.entry_id) as entry_id, coalesce(s.tree_oid, case when s.entry_id is null then n.tree_oid end) as tree_oid,
      case when c.entry_id is not null then 'blocked' else s.capture_state end as capture_state
    from slot s full join (select k.session_id, k.ancestor_id as entry_id from closure k join ({LEAF}) l on l.session_id = k.session_id and l.entry_id = k.entry_id) c on c.session_id = s.session_id and c.entry_id = s.entry_id
    left join nearest n on n.session_id = c.session_id and n.entry_id = c.entry_id""",
    "nearest",
)
def barrier_reconcile(spark, d):
    g, s = graph(spark, d), fx.slots(spark, d)
    leaf = g.groupBy("session_id").agg(F.max_by("entry_id", "ord").alias("entry_id"))
    return slots.reconcile_barrier(history.above(g, leaf), s, history.nearest_checkpoint(g, s))


STATE = "select user_id as session_id, event_id as entry_id, sha256(cast(event_id as varchar)) as tree_oid from events where event_type in ('purchase', 'click')"
GUARD = "select user_id as session_id, event_id as entry_id from events where event_id % 4 = 0 and event_type in ('click', 'signup')"


@query(
    f"""select s.session_id, s.entry_id, s.tree_oid, case when g.entry_id is null then 'open' else 'blocked' end as capture_state from ({STATE}) s left join ({GUARD}) g using (session_id, entry_id)
    union all select g.session_id, g.entry_id, null, 'blocked' from ({GUARD}) g anti join ({STATE}) s using (session_id, entry_id)"""
)
def migrate_v2_v3(spark, d):
    e = fx.table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("entry_id"), "event_type")
    states = e.filter("event_type in ('purchase', 'click')").select("session_id", "entry_id", F.expr("sha2(cast(entry_id as string), 256)").alias("tree_oid"))
    return slots.from_guards(states, e.filter("entry_id % 4 = 0 and event_type in ('click', 'signup')").select("session_id", "entry_id"))


@query("select session_id, entry_id, case when tree_oid < '8' then sha256(tree_oid || 'v4') else tree_oid end as tree_oid, capture_state from slot", "slot")
def tree_root_rewrite(spark, d):
    s = fx.slots(spark, d)
    mapping = s.filter("tree_oid < '8'").select(F.col("tree_oid").alias("old_oid"), F.expr("sha2(concat(tree_oid, 'v4'), 256)").alias("new_oid")).distinct()
    return slots.replace_roots(s, mapping)


@query("select case when old is null then 'missing' else 'extra' end as problem, coalesce(oid, old) as oid from (select distinct tree_oid as oid from slot where tree_oid is not null) full join (select distinct case when event_id % 50 = 0 then 'x' || sha256(cast(event_id as varchar)) else sha256(cast(event_id as varchar)) end as old from events where event_type = 'purchase') on oid = old where oid is null or old is null", "slot")
def upgrade_map_problems(spark, d):
    roots = fx.slots(spark, d).filter("tree_oid is not null").select(F.col("tree_oid").alias("oid")).distinct()
    e = fx.table(spark, d, "events").filter("event_type = 'purchase'")
    return manifest.upgrade_is_total(roots, e.select(F.expr("concat(case when event_id % 50 = 0 then 'x' else '' end, sha2(cast(event_id as string), 256))").alias("old_oid")).distinct())


@query(
    """select g.session_id + 1000000 as session_id, g.entry_id, s.tree_oid, coalesce(s.capture_state, 'blocked') as capture_state from graph g left join slot s on s.session_id = g.session_id and s.entry_id = g.entry_id
    where g.ord % 3 <> 2 and not (s.entry_id is null and g.ord = 0)""",
    "graph", "slot",
)
def fork_projection(spark, d):
    g = graph(spark, d).filter("ord % 3 <> 2").select((F.col("session_id") + 1000000).alias("session_id"), F.col("session_id").alias("source_session"), "entry_id", "ord")
    return slots.project_fork(g.drop("ord"), fx.slots(spark, d), g.filter("ord = 0"))


@query("select session_id, entry_id, tree_oid, capture_state from slot union all select session_id, entry_id, null, 'blocked' from graph anti join slot using (session_id, entry_id)", "graph", "slot")
def pending_verification(spark, d):
    return slots.verify_pending(graph(spark, d), fx.slots(spark, d))


@query(
    """with r as (select c_custkey as session_id, 'file-' || c_custkey as session_file from customer where c_custkey % 3 <> 0),
    q as (select c_custkey as session_id, 'file-' || (case when c_custkey % 5 = 0 then c_custkey + 1 else c_custkey end) as session_file from customer)
    select q.session_id, q.session_file, case when not exists (select 1 from r where r.session_id = q.session_id or r.session_file = q.session_file) then 'absent'
      when exists (select 1 from r where r.session_id = q.session_id and r.session_file = q.session_file) and not exists (select 1 from r where (r.session_id = q.session_id) <> (r.session_file = q.session_file)) then 'exact' else 'conflict' end as outcome from q"""
)
def session_identity(spark, d):
    c = fx.table(spark, d, "customer")
    registry = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("session_id"), F.expr("concat('file-', c_custkey)").alias("session_file"))
    return slots.match_identity(c.select(F.col("c_custkey").alias("session_id"), F.expr("concat('file-', case when c_custkey % 5 = 0 then c_custkey + 1 else c_custkey end)").alias("session_file")), registry)


@query(
    """with s as (select session_id, case when entry_id % 60 = 0 then entry_id + 100000000 else entry_id end as entry_id, case when entry_id % 70 = 0 then null else tree_oid end as tree_oid, capture_state from slot
      union all select session_id, entry_id, tree_oid, capture_state from slot where entry_id % 50 = 1)
    select 'duplicate' as rule, session_id, entry_id from s group by all having count(*) > 1 union all select 'open-without-tree', session_id, entry_id from s where capture_state = 'open' and tree_oid is null
    union all select distinct 'outside-graph', session_id, entry_id from s anti join graph using (session_id, entry_id)""".replace("with s", "select * from (with s", 1) + ")",
    "graph", "slot",
)
def slot_violations(spark, d):
    s = fx.slots(spark, d)
    odd = s.withColumn("tree_oid", F.expr("case when entry_id % 70 = 0 then null else tree_oid end")).withColumn("entry_id", F.expr("case when entry_id % 60 = 0 then entry_id + 100000000 else entry_id end"))
    return slots.violations(odd.unionByName(s.filter("entry_id % 50 = 1")), graph(spark, d))


@query("select tree_oid from (select distinct tree_oid from slot where tree_oid is not null) order by tree_oid", "slot")
def gc_roots_bounded(spark, d):
    return planning.root_pages(fx.slots(spark, d), 1_000_000).orderBy("page", "tree_oid").select("tree_oid")


@query("select session_id, entry_id, case when entry_id % 5 = 0 then sha256('up-' || entry_id) else tree_oid end as tree_oid, case when entry_id % 5 = 0 then 'open' else capture_state end as capture_state from slot", "slot")
def slot_upsert(spark, d):
    s = fx.slots(spark, d)
    changes = s.filter("entry_id % 5 = 0").select("session_id", "entry_id", F.expr("sha2(concat('up-', entry_id), 256)").alias("tree_oid"), F.lit("open").alias("capture_state"))
    return slots.upsert(s, changes)


@query("select c_custkey as session_id, 'verified' as state, c_custkey % 4 = 0 as capture_barrier from customer")
def registry_barriers(spark, d):
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("session_id"))
    return metadata.with_barrier(c.withColumn("state", F.lit("verified")), c.filter("session_id % 4 = 0"))


@query("select c_custkey as session_id, c_custkey in (select session_id from slot) as has_slot, c_custkey % 4 = 0 as has_barrier from customer", "slot")
def registry_orphans(spark, d):
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("session_id"))
    return metadata.orphans(c, fx.slots(spark, d), c.filter("session_id % 4 = 0"))


@query("select ps as device, inode, min(path) as path from (select l_suppkey % 7 as ps, l_partkey % 50 as inode, 'w/' || l_orderkey as path from lineitem) group by all")
def lock_order(spark, d):
    rows = fx.table(spark, d, "lineitem").selectExpr("l_suppkey % 7 as device", "l_partkey % 50 as inode", "concat('w/', l_orderkey) as path")
    return metadata.lock_order(rows)


@query("select c_custkey as id, 'CREATE TABLE t' || c_custkey || '(a TEXT,b INT)' as sql from customer")
def schema_texts(spark, d):
    c = fx.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), metadata.normalized(F.concat(F.lit(" CREATE  TABLE\n t"), "c_custkey", F.lit(" ( a TEXT ,  b\tINT )\n"))).alias("sql"))


# packs and maintenance


@query("select distinct tree_oid from slot where tree_oid is not null", "slot")
def gc_roots(spark, d):
    return planning.roots(fx.slots(spark, d))


ROOTS = "select sha256('tree-' || o_orderkey) as tree_id from orders where o_orderstatus = 'O'"


@query(f"select 'tree-root' as kind, tree_id as logical_id from ({ROOTS}) union select 'content', blob_id from edge where tree_id in ({ROOTS})", "edge")
def gc_live_keys(spark, d):
    roots = fx.table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.expr("sha2(concat('tree-', o_orderkey), 256)").alias("tree_id"))
    return storage.reachable(roots, fx.edges(spark, d).select("tree_id", F.col("blob_id").alias("logical_id")))


CLASSES = """select pack_id, case when live_n = 0 then 'dead' when dead_n = 0 then 'live' when dead_n * 2 >= live_n + dead_n or dead_b * 2 >= live_b + dead_b then 'partial' else 'keep' end as class, live_n, dead_n, live_b, dead_b
    from (select pack_id, count(*) filter (alive) as live_n, count(*) filter (not alive) as dead_n, cast(coalesce(sum(length) filter (alive), 0) as bigint) as live_b, cast(coalesce(sum(length) filter (not alive), 0) as bigint) as dead_b
          from (select p.pack_id, p.length, p.logical_id in (select logical_id from pack_entry where alive) as alive from pack_entry p) group by pack_id)"""


def classes(spark, d) -> DataFrame:
    return storage.pack_classes(fx.pack_entries(spark, d), fx.live(spark, d))


@query(CLASSES, "pack_entry")
def gc_pack_classes(spark, d):
    return classes(spark, d)


@query("select logical_id, min(pack_id) as owner_pack from pack_entry where logical_id in (select logical_id from pack_entry where alive) group by logical_id having count(distinct pack_id) > 1", "pack_entry")
def gc_duplicate_owner(spark, d):
    return storage.duplicate_owners(fx.pack_entries(spark, d), fx.live(spark, d))


SMALL = "select case when l_suppkey % 2 = 0 then 'data' else 'metadata' end as class, sha256('tier-' || l_suppkey || '-' || l_linenumber || '-' || l_returnflag) as pack_id, cast(sum(l_quantity) as bigint) * 300 as size from lineitem group by l_suppkey, l_linenumber, l_returnflag"


@query(
    f"""select class, tier, pack_id from (select *, min(tier) filter (n >= 4) over (partition by class) as lowest, row_number() over (partition by class, tier order by pack_id) as k from
      (select *, length(bin(size)) - 1 as tier, count(*) over (partition by class, length(bin(size))) as n from ({SMALL}) where size * 4 < case class when 'data' then 33554432 else 4194304 end)) where tier = lowest and k <= 4"""
)
def gc_size_tiers(spark, d):
    own = fx.table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber", "l_returnflag").agg((F.sum("l_quantity").cast("long") * 300).alias("size"))
    packs = own.select(F.expr("case when l_suppkey % 2 = 0 then 'data' else 'metadata' end").alias("class"), F.expr("sha2(concat('tier-', l_suppkey, '-', l_linenumber, '-', l_returnflag), 256)").alias("pack_id"), "size")
    return storage.size_tiers(packs).select("class", F.col("tier").cast("long").alias("tier"), "pack_id")


def occurrences(spark, d) -> DataFrame:
    return fx.edges(spark, d).select("path", F.col("blob_id").alias("content_id"))


def lengths(spark, d) -> DataFrame:
    return fx.pack_entries(spark, d).groupBy(F.col("logical_id").alias("content_id")).agg(F.min("decoded_length").alias("decoded_length"))


RANKED = """select path, content_id, n, rank from (select path, content_id, n, row_number() over (partition by path order by n desc, l, content_id) as rank
    from (select path, blob_id as content_id, count(*) as n from edge group by all) join (select logical_id as content_id, min(decoded_length) as l from pack_entry group by all) using (content_id)) where rank <= 8"""


@query(RANKED, "edge", "pack_entry")
def gc_occurrences_top8(spark, d):
    return storage.ranked_contents(occurrences(spark, d), lengths(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""with r as (select * from ({RANKED}) join (select logical_id as content_id, min(decoded_length) as l from pack_entry group by all) using (content_id))
    select path, content_id, anchor_id, rank from (select a.path, a.content_id, b.content_id as anchor_id, row_number() over (partition by a.path, a.content_id order by abs(a.l - b.l), b.n desc, b.l, b.content_id) as rank
    from r a join r b on a.path = b.path and b.rank < a.rank and abs(a.l - b.l) * 100 <= greatest(a.l, b.l) * 25) where rank <= 4""".replace("with r as", "select * from (with r as", 1) + ")",
    "edge", "pack_entry",
)
def gc_delta_candidates(spark, d):
    size = lengths(spark, d)
    return storage.delta_candidates(storage.ranked_contents(occurrences(spark, d), size), size).withColumn("rank", F.col("rank").cast("long"))


@query(
    """select object_id, reason from (select sha256('obj-' || o_orderkey) as object_id, case when o_orderkey % 7 = 0 then case when o_orderdate < '1997-01-01' then 'temporary' end
      when o_orderkey % 3 <> 0 then case when o_orderdate < '1997-01-01' then 'dead' end when o_orderkey % 5 = 0 then 'superseded' end as reason from orders) where reason is not null"""
)
def gc_sweep(spark, d):
    o = fx.table(spark, d, "orders").withColumn("object_id", F.expr("sha2(concat('obj-', o_orderkey), 256)"))
    objects = o.select("object_id", F.expr("o_orderkey % 7 = 0").alias("temporary"), F.col("o_orderdate").alias("modified"))
    return storage.sweep(objects, o.filter("o_orderkey % 3 = 0").select("object_id"), o.filter("o_orderkey % 5 = 0").select("object_id"), F.expr("timestamp_ntz '1997-01-01 00:00:00'"))


@query("select logical_id, arg_min(pack_id, struct_pack(l := length, p := pack_id)) as pack_id, min(length) as length from pack_entry where logical_id in (select logical_id from pack_entry where alive) group by logical_id", "pack_entry")
def gc_retained_coverage(spark, d):
    return storage.best_copies(fx.pack_entries(spark, d), fx.live(spark, d))


@query(
    f"""select count(*) filter (class = 'dead') as dead_packs, count(*) filter (class = 'partial') as partial_packs, count(*) filter (class = 'live') as live_packs, count(*) filter (class = 'keep') as keep_packs,
    cast(sum(dead_b) filter (class in ('dead', 'partial')) as bigint) as freed_bytes, (select count(*) from orders where o_orderkey % 7 = 0 and o_orderdate < '1997-01-01') as temporary_objects,
    (select count(*) from orders where o_orderkey % 7 <> 0 and o_orderkey % 3 <> 0 and o_orderdate < '1997-01-01') as dead_objects, (select count(*) from orders where o_orderkey % 7 <> 0 and o_orderkey % 3 = 0 and o_orderkey % 5 = 0) as superseded_objects from ({CLASSES})""",
    "pack_entry",
)
def gc_report(spark, d):
    return storage.report(classes(spark, d), gc_sweep(spark, d))


VARINT = "cast(ceil(length(bin({0})) / 7.0) as bigint)"
INDEX = f"""select logical_id, dense_rank() over (order by pack_id) - 1 as pack_ordinal, row_number() over w - 1 as ordinal,
    cast(7 + {VARINT.format('count(*) over (partition by pack_id)')} + coalesce(sum(f) over (partition by pack_id order by logical_id rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset", f as length
    from (select pack_id, logical_id, length + {VARINT.format('length')} as f from pack_entry) window w as (partition by pack_id order by logical_id)"""


def index(spark, d) -> DataFrame:
    return storage.index_entries(fx.pack_entries(spark, d)).withColumn("pack_ordinal", F.col("pack_ordinal").cast("long")).withColumn("ordinal", F.col("ordinal").cast("long"))


@query(INDEX, "pack_entry")
def midx_entries(spark, d):
    return index(spark, d)


@query("select bucket, cast(sum(n) over (order by bucket) as bigint) as cumulative from (select b as bucket, count(logical_id) as n from range(256) r(b) left join pack_entry on cast('0x' || logical_id[1:2] as integer) = b group by b)", "pack_entry")
def midx_fanout(spark, d):
    return storage.fanout(fx.pack_entries(spark, d)).withColumn("bucket", F.col("bucket").cast("long"))


@query(
    f"""with i as ({INDEX}) select q.logical_id, coalesce(m.state, 'absent') as state from (select distinct blob_id as logical_id from edge union select sha256('none-' || n_nationkey) from nation) q
    left join (select logical_id, max(case when pack_ordinal % 7 = 0 then 'stale' else 'current' end) as state from i group by all) m using (logical_id)""".replace("with i", "select * from (with i", 1) + ")",
    "edge", "pack_entry",
)
def midx_lookup(spark, d):
    i = index(spark, d)
    moved = i.withColumn("offset", F.expr("case when pack_ordinal % 7 = 0 then offset + 1 else offset end"))
    wanted = fx.edges(spark, d).select(F.col("blob_id").alias("logical_id")).distinct().unionByName(fx.table(spark, d, "nation").select(F.expr("sha2(concat('none-', n_nationkey), 256)").alias("logical_id")))
    return storage.lookups(wanted, i, moved)


@query("select doc_id as id, strlen(text) - (strlen(text) - doc_id % 200) >= greatest(64, (strlen(text) * 5 + 99) // 100) as useful from documents")
def compression_gate(spark, d):
    n = F.octet_length("text")
    return fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), storage.compression_useful(n, n - F.col("doc_id") % 200).alias("useful"))


@query("select doc_id as id, strlen(text) - s >= 128 and (strlen(text) - s) * 100 >= strlen(text) * 35 as useful, greatest(strlen(text), s) > 0 and abs(strlen(text) - s) * 100 <= greatest(strlen(text), s) * 25 as near from (select *, doc_id * 7 % 4000 as s from documents)")
def delta_gate(spark, d):
    n, s = F.octet_length("text").cast("long"), F.expr("doc_id * 7 % 4000")
    return fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), storage.delta_useful(n, s).alias("useful"), storage.lengths_near(n, s).alias("near"))


@query("select o_orderkey as id, t > 128 and s > 0 and s <= 4 * greatest(128, (t * 35 + 99) // 100) as useful from (select o_orderkey, o_orderkey % 20000 as t, o_custkey * 13 % 30000 as s from orders)")
def rewrite_gate(spark, d):
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), storage.rewrite_worthwhile(F.expr("o_orderkey % 20000"), F.expr("o_custkey * 13 % 30000")).alias("useful"))


#: The 13 values, by name.
CAPACITY = {
    "new_records": "l_partkey % 6 - 1", "new_packs": "l_suppkey % 3", "largest_incoming_bytes": "l_orderkey % 50", "current_objects": "l_partkey % 11", "current_index_entries": "l_suppkey % 11",
    "current_packs": "l_linenumber % 4", "current_incoming_files": "l_orderkey % 2", "current_incoming_bytes": "l_partkey % 30", "max_objects": "13 + l_suppkey % 2", "max_index_entries": "14", "max_packs": "5",
    "max_incoming_files": "1", "max_incoming_bytes": "60 + l_orderkey % 9",
}
ROOM = "({0} >= 0 and current_{1} >= 0 and max_{1} >= current_{1} and {0} <= max_{1} - current_{1})"


@query(
    f"""select l_orderkey as id, l_linenumber as line, {ROOM.format('new_records', 'objects')} and {ROOM.format('new_records', 'index_entries')} and {ROOM.format('new_packs', 'packs')}
      and (new_packs = 0 or {ROOM.format('1', 'incoming_files')} and {ROOM.format('largest_incoming_bytes', 'incoming_bytes')}) as fits
    from (select l_orderkey, l_linenumber, {', '.join(f'{v} as {k}' for k, v in CAPACITY.items())} from lineitem)"""
)
def capacity_fence(spark, d):
    rows = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.expr(v).alias(k) for k, v in CAPACITY.items()))
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), storage.additive_capacity().alias("fits"))


@query(
    """select l_orderkey as id, l_linenumber as line, l_linenumber % 5 > 0 and sp = 4 and sb > 0 and pa - pb < sp and ba - bb <= sb as convergent from (select l_orderkey, l_linenumber, l_partkey % 3 as pb, l_partkey % 3 + l_suppkey % 6 as pa,
      l_orderkey % 1000 as bb, l_orderkey % 1000 + l_partkey % 90 as ba, 3 + l_linenumber % 2 as sp, l_suppkey % 70 as sb from lineitem)"""
)
def tier_convergence(spark, d):
    rows = fx.table(spark, d, "lineitem")
    e = F.expr
    ok = storage.tier_convergent(e("l_linenumber % 5 > 0"), e("l_partkey % 3"), e("l_partkey % 3 + l_suppkey % 6"), e("l_orderkey % 1000"), e("l_orderkey % 1000 + l_partkey % 90"), e("3 + l_linenumber % 2"), e("l_suppkey % 70"))
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), ok.alias("convergent"))


@query("select c_custkey as id, case when c_custkey % 3 = 0 then 'legacy-unattested' when c_custkey % 5 <> 1 then 'version-mismatch' else 'none' end as risk from customer")
def replay_risks(spark, d):
    recorded = F.expr("case when c_custkey % 3 > 0 then concat('git version ', c_custkey % 5) end")
    return fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), planning.replay_risk(recorded, F.lit("git version 1")).alias("risk"))


@query("select c_custkey as id, c_custkey % 4 > 0 and c_custkey % 50 + case c_custkey % 4 when 1 then 10 when 2 then 30 else 60 end <= 70 as due from customer")
def maintenance_due(spark, d):
    c = fx.table(spark, d, "customer")
    interval = F.expr("case c_custkey % 4 when 0 then 0 when 1 then 10 when 2 then 30 else 60 end")
    return c.select(F.col("c_custkey").alias("id"), sessions.due(F.lit(70), F.expr("nullif(c_custkey % 50, 0)"), interval).alias("due"))


@query("select scope, cast(count(distinct path) as bigint) as sources, cast(any_value(total) as bigint) as bytes, min(seq) filter (run > 30000 or n > 20) as first_over from (select *, last_value(run) over (partition by scope order by seq rows between unbounded preceding and unbounded following) as total from (select *, sum(b - coalesce(p, 0)) over (partition by scope order by seq) as run, sum((p is null)::int) over (partition by scope order by seq) as n from (select *, lag(b) over (partition by scope, path order by seq) as p from (select o_custkey as scope, o_orderkey as seq, 'd' || (o_orderkey % 7) as path, o_orderkey * 13 % 9000 as b from orders)))) group by scope")
def policy_budgets(spark, d):
    changes = fx.table(spark, d, "orders").selectExpr("o_custkey as scope", "o_orderkey as seq", "concat('d', o_orderkey % 7) as path", "o_orderkey * 13 % 9000 as bytes")
    return planning.policy_budget(changes, 20, 30_000)


@query(
    """select 'cached' as side, pack_id, logical_id, length from (select pack_id, logical_id, case when pack_id < '3' then length + 1 else length end as length from pack_entry where logical_id > '1' except all select pack_id, logical_id, length from pack_entry)
    union all select 'footers', pack_id, logical_id, length from (select pack_id, logical_id, length from pack_entry except all select pack_id, logical_id, case when pack_id < '3' then length + 1 else length end from pack_entry where logical_id > '1')""",
    "pack_entry",
)
def index_differences(spark, d):
    own = fx.pack_entries(spark, d).select("pack_id", "logical_id", "length")
    cached = own.filter("logical_id > '1'").withColumn("length", F.expr("case when pack_id < '3' then length + 1 else length end"))
    return planning.index_differences(cached, own)


@query(
    """with n as (select pack_id, logical_id, row_number() over (partition by pack_id order by logical_id) - 1 as o from pack_entry)
    select a.pack_id, a.logical_id, b.logical_id as base_id from n a left join n b on a.pack_id = b.pack_id and b.o = a.o - (1 + a.o % 5) where a.o % 3 = 0""".replace("with n", "select * from (with n", 1) + ")",
    "pack_entry",
)
def delta_bases(spark, d):
    own = fx.pack_entries(spark, d).withColumn("ordinal", F.row_number().over(Window.partitionBy("pack_id").orderBy("logical_id")) - 1)
    return planning.delta_chain(own.withColumn("back", F.expr("case when ordinal % 3 = 0 then 1 + ordinal % 5 end")))


@query("select logical_id as target_id, arg_min(pack_id, struct_pack(l := length, p := pack_id)) as base_id, min(length) as payload_bytes from pack_entry where length % 128 = 0 group by logical_id", "pack_entry")
def gc_best_bases(spark, d):
    tried = fx.pack_entries(spark, d).select(F.col("logical_id").alias("target_id"), F.col("pack_id").alias("base_id"), F.expr("case when length % 128 = 0 then length end").alias("payload_bytes"))
    return compaction.best_bases(tried)


@query("select content_id, cast(count(*) as bigint) as objects, cast(sum(length) as bigint) as bytes from (select distinct content_id, x from (select tree_id as content_id, blob_id as x from edge union all select tree_id, tree_id from edge)) join (select logical_id, min(length) as length from pack_entry group by all union all select distinct tree_id, 7 from edge) on x = logical_id group by content_id", "edge", "pack_entry")
def gc_closures(spark, d):
    e = fx.edges(spark, d)
    sizes = fx.pack_entries(spark, d).groupBy("logical_id").agg(F.min("length").alias("length")).unionByName(e.select(F.col("tree_id").alias("logical_id"), F.lit(7).cast("long").alias("length")).distinct())
    return storage.closures(e.select(F.col("tree_id").alias("content_id")), e.select(F.col("tree_id").alias("parent_id"), F.col("blob_id").alias("child_id")).distinct(), sizes)


@query("select tree_id, rule from (select tree_id, unnest([case when lost > 0 then 'missing-blob' end, case when bytes > 30000 then 'over-quota' end, case when n > 6 then 'too-many-entries' end]) as rule from (select tree_id, count(*) as n, sum(length) as bytes, count(*) filter (length is null) as lost from edge left join (select logical_id, min(length) as length from pack_entry where logical_id > '2' group by all) on logical_id = blob_id group by tree_id)) where rule is not null", "edge", "pack_entry")
def import_preflight(spark, d):
    sizes = fx.pack_entries(spark, d).filter("logical_id > '2'").groupBy(F.col("logical_id").alias("blob_id")).agg(F.min("length").alias("length"))
    return manifest.import_preflight(fx.edges(spark, d).select("tree_id", "blob_id"), sizes, 30_000, 6)


#: Sequential admission in SQL: one row at a time, in order of key.
ADMITTED = """k as (select *, row_number() over (partition by class order by key) as i from ({0})),
    run as (select class, key, i, n <= {1} as ok, case when n <= {1} then {1} - n else {1} end as room from k where i = 1
      union all select k.class, k.key, k.i, k.n <= run.room, case when k.n <= run.room then run.room - k.n else run.room end from run join k on k.class = run.class and k.i = run.i + 1)"""
SUPPLIERS = "select 'c' || (s_nationkey % 3) as class, sha256(cast(s_suppkey as varchar)) as key, cast(s_suppkey * 37 % 1000 as bigint) as n from supplier"


@query("with recursive " + ADMITTED.format(SUPPLIERS, 4000) + " select class, key from run where ok")
def gc_budget_admission(spark, d):
    rows = fx.table(spark, d, "supplier").selectExpr("concat('c', s_nationkey % 3) as class", "sha2(cast(s_suppkey as string), 256) as key", "s_suppkey * 37 % 1000 as decoded_length")
    return storage.admit_within_budget(rows, 4000)


# content kernels


#: The chunks of 1 MiB of bytes from a linear congruential generator.
LCG_LENGTHS = (94469, 70941, 70712, 89051, 37196, 71364, 74862, 67831, 66913, 72733, 86376, 130609, 17352, 85242, 12925)


def generated(spark, d, contents: int) -> DataFrame:
    """content_id, ord, piece: the generator's bytes in pieces of 64 KiB, as often as there are nations, the first byte of each dropped by turns."""

    def run(batches):
        for batch in batches:
            for key in batch.column(0).to_pylist():
                x, out = 0x12345678, bytearray()
                for _ in range(1 << 20):
                    x = (x * 1664525 + 1013904223) & 0xFFFFFFFF
                    out.append(x >> 24)
                step = 65_536 + key * 1000
                parts = [bytes(out[a : a + step]) for a in range(0, len(out), step)]
                yield pa.RecordBatch.from_arrays([pa.array([str(key)] * len(parts)), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], names=["content_id", "ord", "piece"])

    few = fx.table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("k")).limit(contents)
    return few.repartition(contents).mapInArrow(run, "content_id string, ord long, piece binary")


@query(f"select cast(r_regionkey as varchar) as content_id, cast(i - 1 as bigint) as ord, cast([{', '.join(map(str, LCG_LENGTHS))}][i] as bigint) as length from region, range(1, {len(LCG_LENGTHS) + 1}) t(i)")
def content_chunks(spark, d):
    """The published vector, whatever the pieces in which the content comes."""
    return chunks.chunk_pieces(written(generated(spark, d, 5), "pieces")).select("content_id", "ord", "length")


@query("select cast(doc_id as varchar) as content_id, case when text is null then 0 else cast(strlen(text) as bigint) end as bytes, 0 as gaps, sha256(text) as oid from documents where strlen(text) > 0")
def content_chunks_cover(spark, d):
    """Chunks of every document: they follow one another, cover it, and joined they have its digest."""
    docs = fx.table(spark, d, "documents").filter(F.octet_length("text") > 0).select(F.col("doc_id").cast("string").alias("content_id"), F.col("text").cast("binary").alias("content"))
    cut_ = chunks.chunk(docs).join(docs, "content_id")
    before = F.coalesce(F.sum("length").over(Window.partitionBy("content_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sound = cut_.withColumn("gap", before != F.col("offset")).withColumn("piece", F.expr("substring(content, int(offset) + 1, int(length))"))
    oids = chunks.digests(sound)
    sums = sound.groupBy("content_id").agg(F.sum("length").alias("bytes"), F.count_if(F.col("gap") | (F.sha2("piece", 256) != F.col("chunk_id"))).cast("int").alias("gaps"))
    return sums.join(oids.select("content_id", "oid"), "content_id")


def long_chunks(spark, d) -> DataFrame:
    """Chunks as of a content for each supplier, of up to 20 MB, each chunk of 20,000 bytes but the last."""
    o = fx.table(spark, d, "supplier").select(F.sha2(F.col("s_suppkey").cast("string"), 256).alias("content_id"), F.expr("cast(s_suppkey * 7919 % 1000 as long) * 20011 + 70000").alias("n"))
    each = o.select("content_id", "n", F.explode(F.expr("sequence(0L, (n - 1) div 20000)")).alias("ord"))
    return each.select("content_id", "ord", F.least(F.lit(20_000).cast("long"), F.col("n") - F.col("ord") * 20_000).alias("length"), F.sha2(F.concat("content_id", F.lit("-"), F.col("ord").cast("string")), 256).alias("chunk_id"))


LONG = "select sha256(cast(s_suppkey as varchar)) as content_id, n, ceil(n / 20000.0) as c from (select s_suppkey, cast(s_suppkey * 7919 % 1000 as bigint) * 20011 + 70000 as n from supplier)"
RECIPES = f"""select content_id, cast(c as bigint) as chunks, n as decoded_length, cast(case when c > 768 then 3 else 2 end as integer) as depth,
    cast(case when c > 768 then 4 else 2 end as bigint) as nodes from ({LONG})"""


@query(RECIPES)
def content_recipes(spark, d):
    return chunks.recipe_objects(long_chunks(spark, d)).filter("level = -1").select("content_id", "chunks", "decoded_length", "depth", "nodes")


@query(f"select content_id, o as ord, sha256(content_id || '-' || o) as chunk_id from (select content_id, unnest(range(cast(c as bigint))) as o from ({LONG}))")
def recipe_round_trip(spark, d):
    """Recipe objects written, read as references, and flattened to their chunks in order."""
    made = written(chunks.recipe_objects(long_chunks(spark, d)), "recipes")
    edges, _ = chunks.recipe_edges(made)
    return planning.flatten_recipes(made.filter("level = -1").select("content_id", F.col("recipe_id").alias("node_id")), edges).withColumn("ord", F.col("ord").cast("long"))


EDITED = "select doc_id, text as base, substr(text, 1, cast(length(text) // 3 as bigint)) || '#' || doc_id || '#' || substr(text, cast(length(text) // 3 + 2 as bigint)) as target from documents where length(text) > 10"


@query(f"select cast(doc_id as varchar) as content_id, sha256(target) as oid, strlen(target) as length from ({EDITED}) where strlen(target) <= 262144 and strlen(base) <= 262144")
def content_deltas(spark, d):
    """Every document with one character changed, as a delta against the document, applied again."""
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    docs = fx.table(spark, d, "documents").filter(n > 10)
    target = F.concat(F.substring("text", F.lit(1), third), F.lit("#"), F.col("doc_id").cast("string"), F.lit("#"), F.substring("text", third + 2, n))
    pairs = docs.select(F.col("doc_id").cast("string").alias("content_id"), F.col("text").cast("binary").alias("base"), target.cast("binary").alias("target"))
    made = chunks.deltas(pairs).join(pairs, "content_id")
    again = F.concat(F.expr("substring(base, 1, int(prefix))"), F.expr("substring(target, int(prefix) + 1, int(added))"), F.expr("substring(base, octet_length(base) - int(suffix) + 1, int(suffix))"))
    return made.select("content_id", F.sha2(again, 256).alias("oid"), F.octet_length(again).cast("long").alias("length"))


@query("select cast(doc_id as varchar) as content_id, strlen(text) <= 64 as small, true as sound from documents where text is not null")
def content_payloads(spark, d):
    """Payloads are raw where they are small, and no longer than the content less what compression must save."""
    docs = fx.table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("content_id"), F.col("text").cast("binary").alias("content"))
    both = chunks.payloads(docs).join(docs.select("content_id", F.octet_length("content").cast("long").alias("n")), "content_id")
    raw = (F.col("encoding") == "raw") & (F.col("length") == F.col("n"))
    packed = (F.col("encoding") == "zstd-v1") & storage.compression_useful(F.col("n"), F.col("length")) & (F.col("n") > 64)
    return both.select("content_id", (F.col("n") <= 64).alias("small"), (raw | packed).alias("sound"))


@query("select sha256(cast(o_orderkey as varchar)) as content_id, case when n > 65536 and c >= 2 then 'chunked' else 'full' end as representation from (select o_orderkey, cast(o_orderkey as bigint) * 17 as n, ceil(o_orderkey * 17 / 70000.0) as c from orders)")
def content_representations(spark, d):
    o = fx.table(spark, d, "orders").withColumn("n", F.col("o_orderkey").cast("long") * 17)
    return o.select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("content_id"), objects.representation(F.col("n"), F.ceil(F.col("n") / 70_000)).alias("representation"))


@query("select case k when 1 then 'few-chunks' when 2 then 'chunk-size' else 'length' end as rule, content_id from (select sha256(cast(o_orderkey as varchar)) as content_id, o_orderkey % 9 as k from orders) where k between 1 and 3")
def recipe_problems(spark, d):
    """Chunk lists of which some have one chunk, a chunk below the minimum, or another length."""
    o = fx.table(spark, d, "orders").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("content_id"), (F.col("o_orderkey") % 9).alias("k"))
    each = o.withColumn("ord", F.explode(F.expr("sequence(0L, if(k = 1, 0L, 3L))"))).withColumn("length", F.expr("if(k = 2 and ord = 1, 16383L, 20000L)"))
    sums = each.groupBy("content_id").agg((F.sum("length") + F.max(F.expr("if(k = 3, 1, 0)"))).alias("decoded_length"))
    return chunks.recipe_problems(each, sums)


@query("select content_id, cast(count(*) as bigint) as chunks, cast(sum(l) as bigint) as decoded_length from (select cast(r_regionkey as varchar) as content_id, unnest([" + ", ".join(map(str, LCG_LENGTHS)) + "]) as l from region) group by content_id")
def gc_large_converted(spark, d):
    """Large contents as chunks and recipes; the recipes' roots say how many chunks and bytes there are."""
    whole = written(generated(spark, d, 5), "pieces").groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct("ord", "piece"))).alias("x"))
    glued = whole.select("content_id", F.aggregate("x", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["piece"])).alias("content"))
    named = written(glued.select(F.sha2(F.concat("content_id", F.lit("-content")), 256).alias("id"), "content_id", "content"), "large")
    _, recipes, _ = compaction.convert_large(named.select(F.col("id").alias("content_id"), "content"))
    roots = recipes.filter("level = -1").select(F.col("content_id").alias("id"), "chunks", "decoded_length")
    return roots.join(named.select("id", "content_id"), "id").select("content_id", "chunks", "decoded_length")


def saved_entries(spark, d) -> DataFrame:
    """The saved files of each source as a tree of its own."""
    own = fx.saved(spark, d)
    none = F.lit(None).cast("string")
    return formats.stored_columns(own.select(F.element_at(F.split("path", "/"), 1).alias("tree"), "path", F.col("kind").alias("type"), F.col("oid").alias("blob_oid"), F.lit(420).alias("mode"), F.col("target"), none.alias("symlink_kind")))


@query("""select path[:instr(path, '/') - 1] as tree, cast(0 as bigint) as level, count(*) as entries, max(path) as high_key, 0 as gaps from saved group by all""", "saved")
def tree_nodes(spark, d):
    """The leaves of each tree hold its entries, in order and without gaps."""
    nodes = written(formats.map_nodes(saved_entries(spark, d)), "nodes")
    before = F.lag("high_key").over(Window.partitionBy("tree").orderBy("node"))
    leaves = nodes.filter("level = 0").withColumn("gap", F.coalesce(before >= F.col("high_key"), F.lit(False)))
    return leaves.groupBy("tree", F.col("level").cast("long").alias("level")).agg(F.sum("entries").alias("entries"), F.max("high_key").alias("high_key"), F.count_if("gap").cast("int").alias("gaps"))


# an append-only log, read as a stream


@query(
    f"""with b as ({BROKEN}), n as (select *, row_number() over (partition by session_id order by ord, entry_id) - 1 as place from b), p as (select session_id, entry_id as parent_id, min(ord) as parent_ord from b group by all),
    v as (select session_id, count(*) as broken from (select session_id, entry_id, 'd' as rule from b group by all having count(*) > 1 union all
      select distinct b.session_id, b.entry_id, case when p.parent_ord is null then 'u' else 'f' end from b left join p using (session_id, parent_id) where b.parent_id is not null and (p.parent_ord is null or p.parent_ord >= b.ord)) group by session_id)
    select session_id, count(*) as entries, max(ord) as last_ord, arg_max(entry_id, ord) as leaf_id, cast(count(*) filter (ord <> place) + any_value(coalesce(broken, 0)) as bigint) as violations from n left join v using (session_id) group by session_id""".replace("with b", "select * from (with b", 1) + ")",
    "entry",
)
def observed_sessions(spark, d):
    e = fx.entries(spark, d)
    parent = F.expr("case when entry_id % 97 = 0 then entry_id + 100000000 when entry_id % 89 = 0 then entry_id else parent_id end")
    return observer.observe_batch(e.withColumn("parent_id", parent).unionByName(e.filter("entry_id % 101 = 0")))


@query(
    """with o as (select * from entry where case session_id % 5 when 0 then ord < 4 when 4 then false else true end), n as (select session_id, entry_id, ord, type, parent_id from entry where session_id % 7 <> 3),
    j as (select coalesce(o.session_id, n.session_id) as session_id, o.entry_id as a, n.entry_id as b, coalesce(o.session_id % 3 = 1 and o.ord = 2, false) as changed from o full join n on o.session_id = n.session_id and o.ord = n.ord)
    select session_id, case when count(b) = 0 then 'gone' when count(a) = 0 then 'new' when bool_or(changed) or count(*) filter (a is not null and b is null) > 0 then 're-read' when count(b) > count(a) then 'appended' else 'unchanged' end as outcome,
      cast(case when count(b) = 0 then 0 when count(a) = 0 then count(b) when bool_or(changed) then count(b) else count(b) - count(a) end as bigint) as added from j group by session_id""".replace("with o", "select * from (with o", 1) + ")",
    "entry",
)
def session_reobservation(spark, d):
    """Logs seen before, some of them in part, some with another third entry; some logs are new and some are gone."""
    e = fx.entries(spark, d)
    before = e.filter("case session_id % 5 when 0 then ord < 4 when 4 then false else true end").withColumn("type", F.expr("case when session_id % 3 = 1 and ord = 2 then 'other' else type end"))
    return observer.reobserve(before, e.filter("session_id % 7 <> 3"))


# judgements on sessions


@query("select session_id, entry_id, max(landing_id) as landing_id from landing group by session_id, entry_id", "landing")
def session_landings(spark, d):
    return sessions.landings(fx.entries(spark, d))


@query(
    """select g.session_id, a.entry_id as ancestor_id, g.entry_id as descendant_id, a.type <> 'label' and a.ord < 6 and f.first is not distinct from a.entry_id and g.ord >= 6 as natural
    from graph g join entry a on a.session_id = g.session_id and a.ord = g.entry_id % 9
    left join (select c.session_id, c.entry_id, arg_min(c.ancestor_id, c.depth) as first from closure c join graph o on o.session_id = c.session_id and o.entry_id = c.ancestor_id where o.ord < 6 group by all) f
      on f.session_id = g.session_id and f.entry_id = g.entry_id""",
    "closure",
)
def session_descent(spark, d):
    e = fx.entries(spark, d)
    above = e.select("session_id", F.col("ord").alias("at"), F.col("entry_id").alias("ancestor_id"))
    claims = graph(spark, d).select("session_id", F.col("entry_id").alias("descendant_id"), F.expr("entry_id % 9").alias("at")).join(above, ["session_id", "at"])
    return sessions.natural_descent(e.filter("ord < 6"), e, claims.drop("at"))


@query(
    """select a.session_id, a.entry_id as event_id, case when a.landing_id is not distinct from a.expected then a.landing_id end as landing_id, case when a.landing_id is not distinct from a.expected then 'direct' else 'rejected' end as kind
    from (select l.session_id, l.entry_id, max(l.landing_id) as landing_id, max(case when l.entry_id % 3 = 0 then l.entry_id else l.landing_id end) as expected from landing l group by all) a""",
    "landing",
)
def session_arrivals(spark, d):
    e = fx.entries(spark, d)
    none = F.lit(None).cast("long")
    events = sessions.landings(e).select("session_id", F.col("entry_id").alias("event_id"), none.alias("old_leaf"), F.col("entry_id").alias("new_leaf"), F.col("entry_id").alias("leaf"), none.alias("expected_old"), F.expr("case when entry_id % 3 = 0 then entry_id else landing_id end").alias("expected"), none.alias("summary_id"), none.alias("summary_parent"))
    return sessions.arrivals(events, e)


CLAIM = """c_custkey as session_id, c_custkey % 13 = 0 as registered, case c_custkey % 7 when 0 then 'independent' when 1 then 'rejected' when 2 then 'indeterminate' else 'observed' end as claim,
    case when c_custkey % 7 = 1 then 'source-store-missing' end as reason, c_custkey % 3 > 0 as local, case c_custkey % 5 when 0 then 'absent' when 1 then 'conflict' else 'exact' end as identity, c_custkey % 11 > 0 as verified,
    case when c_custkey % 17 = 0 then 'parent-graph-rewritten' end as again, c_custkey % 19 > 0 as unchanged, c_custkey % 23 > 1 as exact, c_custkey % 29 = 0 as self, c_custkey % 4 > 0 as isolated"""


@query(
    f"""select session_id, case when q is not null then 'quarantine' else p end as disposition, q as reason from (select session_id,
      case when registered then 'present' when claim = 'independent' then 'fresh' when claim = 'indeterminate' then 'retry' when local and identity = 'exact' then 'inherit' else 'import' end as p,
      case when registered or claim in ('independent', 'indeterminate') then null when claim = 'rejected' then reason when local and identity = 'conflict' then 'source-registration-conflict'
        when local and identity = 'exact' and not verified then 'source-registration-unverified' when again is not null then again
        when local and identity = 'exact' then case when not unchanged then 'parent-claim-changed' when not exact then 'source-projection-invalid' end
        when self then 'source-registration-conflict' when local then 'source-registration-absent' when not isolated then 'unsafe-source-topology' end as q from (select {CLAIM} from customer))"""
)
def fork_registration(spark, d):
    return sessions.registration(fx.table(spark, d, "customer").selectExpr(*(x.strip() for x in CLAIM.replace("\n", " ").split(", ") if x.strip())))


@query(
    """select session_id, entry_id, op, before, case when op = 'capture' then case when before like 'blocked%' then 'capture-blocked' when before = 'open-missing' then 'applied' else 'slot-changed' end
        when before = 'blocked-missing' then 'applied' else 'not-blocked-missing' end as outcome
    from (select g.session_id, g.entry_id, case when g.entry_id % 2 = 0 then 'capture' else 'adopt' end as op, case when s.entry_id is null then 'open-missing' when s.tree_oid is null then 'blocked-missing' else s.capture_state || '-checkpoint' end as before
      from graph g left join slot s on s.session_id = g.session_id and s.entry_id = g.entry_id)""",
    "graph", "slot",
)
def node_materialization(spark, d):
    asked = graph(spark, d).select("session_id", "entry_id", F.expr("case when entry_id % 2 = 0 then 'initialise-fresh' else 'adopt-protected' end").alias("intent"), F.expr("sha2(cast(entry_id as string), 256)").alias("oid"))
    return sessions.materialize(asked, fx.slots(spark, d))


# compaction planning


@query("select count(distinct pack_id) as packs, count(*) as records, cast(sum(length) as bigint) as bytes, count(distinct logical_id) as keys from pack_entry", "pack_entry")
def gc_inventory_totals(spark, d):
    return compaction.inventory_totals(fx.pack_entries(spark, d))


@query("select tree_oid, cast(1 + (entry_id % 3 <> 0)::int + (entry_id % 4 <> 0)::int as bigint) as reads from (select tree_oid, min(entry_id) as entry_id from slot where tree_oid is not null group by all) where entry_id % 3 = 0 or entry_id % 4 = 0", "slot")
def gc_root_drift(spark, d):
    roots = fx.slots(spark, d).filter("tree_oid is not null")
    return compaction.root_drift(roots, roots.filter("entry_id % 3 <> 0"), roots.filter("entry_id % 4 <> 0"))


@query("select content_id, cast(c + ceil(c / 768.0) + ceil(c / 368640.0) + 1 as bigint) as at_most from (select cast(o_orderkey as varchar) as content_id, ceil(o_orderkey * 97 / 16384.0) as c from orders where o_orderkey * 97 > 65536)")
def gc_large_legacy(spark, d):
    return compaction.large_legacy(fx.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("content_id"), (F.col("o_orderkey").cast("long") * 97).alias("byte_length")))


SAVED = "select sha256('blob-' || p_partkey || '-0') as base_key, sha256('blob-' || p_partkey || '-1') as target_key, cast(p_size as bigint) * 100 - 500 as saved from part"


@query(
    f"""with a as (select distinct pack_id, logical_id as key, l from (select pack_id, logical_id, sum(length) over (partition by pack_id) as l from pack_entry)),
    x as (select a.pack_id, target_key, saved from ({SAVED}) s join a on a.key = base_key where saved > 0 and target_key not in (select key from a)
      union select a.pack_id, target_key, saved from ({SAVED}) s join a on a.key = target_key where saved > 0 and base_key not in (select key from a))
    select pack_id, cast(coalesce(sum(saved), 0) as bigint) as saved, coalesce(sum(saved), 0) > 0 and any_value(l) <= 4 * coalesce(sum(saved), 0) as kept
    from (select distinct pack_id, l from a) left join x using (pack_id) group by pack_id""".replace("with a", "select * from (with a", 1) + ")",
    "pack_entry",
)
def gc_rewrite_savings(spark, d):
    own = fx.pack_entries(spark, d)
    deltas = fx.table(spark, d, "part").select(F.expr("sha2(concat('blob-', p_partkey, '-0'), 256)").alias("base_key"), F.expr("sha2(concat('blob-', p_partkey, '-1'), 256)").alias("target_key"), F.expr("cast(p_size as long) * 100 - 500").alias("saved"))
    return compaction.rewrite_savings(own.groupBy("pack_id").agg(F.sum("length").alias("size")), own.select("pack_id", F.col("logical_id").alias("key")).distinct(), deltas)


CLASSED = "select case when pack_id < '8' then 'data' else 'metadata' end as class, pack_id, cast(sum(length) as bigint) as size from pack_entry group by all"


@query(f"select class, arg_min(pack_id, struct_pack(s := size, p := pack_id)) as pack_id from ({CLASSED}) where size <= 4 * greatest(128, (case class when 'data' then 10000000 else 20000000 end * 35 + 99) // 100) group by class", "pack_entry")
def gc_opportunistic_source(spark, d):
    return compaction.opportunistic_source(classed(spark, d), spark.createDataFrame([("data", 10_000_000), ("metadata", 20_000_000)], "class string, target long"))


def classed(spark, d) -> DataFrame:
    own = fx.pack_entries(spark, d)
    return own.groupBy(F.expr("case when pack_id < '8' then 'data' else 'metadata' end").alias("class"), "pack_id").agg(F.sum("length").alias("size"))


KEYED = "select 'all' as class, sha256(cast(s_suppkey as varchar)) as key, cast(s_suppkey * 37 % 1000 + s_suppkey % 2 as bigint) as n from supplier"


@query(
    "with recursive " + ADMITTED.format(KEYED, 9000) + """ select 'key' as kind, key as id from run where ok
    union all select 'pack', 'p' || (s_suppkey % 9) from supplier join run on key = sha256(cast(s_suppkey as varchar)) group by s_suppkey % 9 having bool_and(ok)"""
)
def gc_decoded_bound(spark, d):
    own = fx.table(spark, d, "supplier").selectExpr("concat('p', s_suppkey % 9) as pack_id", "sha2(cast(s_suppkey as string), 256) as key", "s_suppkey * 37 % 1000 as low", "s_suppkey * 37 % 1000 + s_suppkey % 2 as high")
    copies = [own.select("key", F.col(c).alias("decoded_length")) for c in ("low", "high")]
    kept, whole = compaction.bound_decoded(own.select("pack_id", "key"), compaction.decoded_lengths(own, *copies), 9000)
    return kept.select(F.lit("key").alias("kind"), F.col("key").alias("id")).unionByName(whole.select(F.lit("pack").alias("kind"), F.col("pack_id").alias("id")))


#: Units in order of key, a new batch where the next would pass 5000; a part with the first key of its unit's.
UNITS = "select class, lead as key, cast(sum(n) as bigint) as n from led group by all"


@query(
    f"""with recursive led as (select 'c' || (s_nationkey % 2) as class, sha256(cast(s_suppkey as varchar)) as key, sha256(cast(case when s_suppkey % 10 = 3 and s_suppkey > 20 then s_suppkey - 20 else s_suppkey end as varchar)) as lead0,
        cast(s_suppkey * 37 % 1000 as bigint) as n, s_nationkey from supplier),
      same as (select l.* exclude lead0, case when b.class is not null and b.class = l.class then lead0 else l.key end as lead from led l left join (select key as k, class from led) b on b.k = lead0),
      k as (select *, row_number() over (partition by class order by key) as i from (select class, lead as key, cast(sum(n) as bigint) as n from same group by all)),
      run as (select class, key, i, cast(0 as bigint) as batch, n as size from k where i = 1
        union all select k.class, k.key, k.i, case when run.size + k.n > 5000 then run.batch + 1 else run.batch end, case when run.size + k.n > 5000 then k.n else run.size + k.n end from run join k on k.class = run.class and k.i = run.i + 1)
    select same.class, same.key, run.batch from same join run on run.class = same.class and run.key = same.lead"""
)
def gc_plan(spark, d):
    own = fx.table(spark, d, "supplier").selectExpr("s_suppkey", "concat('c', s_nationkey % 2) as class", "sha2(cast(s_suppkey as string), 256) as key", "s_suppkey * 37 % 1000 as length")
    pairs = own.filter("s_suppkey % 10 = 3 and s_suppkey > 20").select("class", F.col("key").alias("target_id"), F.expr("sha2(cast(s_suppkey - 20 as string), 256)").alias("base_id"))
    same = pairs.join(own.select("class", F.col("key").alias("base_id")), ["class", "base_id"], "left_semi")
    return compaction.plan(own.select("class", "key", "length"), same.select("target_id", "base_id"), 5000)[0]


# stored records and trees


@query("select distinct 'content' as kind, sha256(text) as logical_id, strlen(text) as length from documents where text is not null")
def record_round_trip(spark, d):
    docs = fx.table(spark, d, "documents").filter("text is not null").select(F.lit("content").alias("kind"), F.col("text").cast("binary").alias("content")).distinct()
    return objects.decode_whole(objects.encode(docs)).select("kind", "logical_id", F.octet_length("content").cast("long").alias("length"))


PACKED = """select logical_id, 'content' as kind, any_value(l) as decoded_length from (select sha256(text) as logical_id, strlen(text) as l from documents where text is not null) group by logical_id"""


def stored_packs(spark, d) -> tuple[DataFrame, str]:
    """Contents of at most one record, packed about 16 MB at a time by a hash of the id; and the folder of the packs."""
    docs = fx.table(spark, d, "documents").filter("text is not null").select(F.lit("content").alias("kind"), F.col("text").cast("binary").alias("content")).distinct()
    records = written(objects.encode(docs), "records")
    home = new_folder(spark, "packs")
    size = records.agg(F.coalesce(F.sum(F.octet_length("payload").cast("long")), F.lit(0))).first()[0]
    packs = written(packfile.pack(records.withColumn("batch", F.pmod(F.xxhash64("logical_id"), F.lit(size // (16 << 20) + 4)))), "packs")
    objects.publish_packs(packs, home)
    return packs, home


@query(PACKED)
def pack_store_round_trip(spark, d):
    """Packs written, listed by their footers, and each record read from its place and decoded."""
    _, home = stored_packs(spark, d)
    read = objects.read_records(spark, home, objects.pack_inventory(spark, home))
    whole = objects.decode_whole(read.drop("pack_id", "ordinal"))
    return whole.filter("content is not null").select("logical_id", "kind", F.octet_length("content").cast("long").alias("decoded_length"))


@query(f"select count(*) as entries, cast(0 as bigint) as differing, cast(sum(decoded_length) as bigint) as bytes from ({PACKED})")
def midx_file(spark, d):
    """The index over all packs written as a file, read again, and compared with the footers."""
    packs, home = stored_packs(spark, d)
    footers = written(objects.pack_inventory(spark, home), "footers")
    objects.write_index(footers, packs.select("pack_id", F.octet_length("data").cast("long").alias("bytes")), f"{home}/index")
    stored, differ = objects.read_index(spark, f"{home}/index", footers)
    return stored.agg(F.count("*").alias("entries"), F.lit(differ.count()).cast("long").alias("differing"), F.sum("decoded_length").alias("bytes"))


@query("select path, oid, 0 as problems from saved", "saved")
def tree_walk(spark, d):
    nodes = written(formats.map_nodes(saved_entries(spark, d)), "nodes")
    entries, problems = trees.read_map(nodes, trees.map_roots(nodes))
    return entries.select("path", F.col("blob_oid").alias("oid"), F.lit(problems.count()).alias("problems"))


FILES = "select source || '/' || lang || '/' || doc_id || case when doc_id % 29 = 3 then '.md' else '.txt' end as path, sha256(coalesce(text, '')) as oid, cast(strlen(coalesce(text, '')) as bigint) as byte_length from documents"


def workspace(spark, d) -> str:
    """A folder with every document as a file; some names are hidden ones."""
    home = new_folder(spark, "workspace")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data")
    name = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.expr("case when doc_id % 29 = 3 then '.md' else '.txt' end")))

    def run(batches):
        store, base = listing.store_of(home)
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{base}/{path}") as f:
                    f.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    written(fx.table(spark, d, "documents").select(name.alias("path"), text).mapInArrow(run, "n long"), "files")
    return home


@query(f"select path, case when byte_length > 20000 then 'too-large' else 'regular' end as kind, case when byte_length <= 20000 then oid end as oid, case when byte_length <= 20000 then byte_length end as byte_length from ({FILES})")
def workspace_scan(spark, d):
    """Every document written as a file; the folder walked, and files up to 20,000 bytes digested."""
    entries, problems, _ = scan.scan(spark, workspace(spark, d), 20_000)
    none = F.lit(None)
    return entries.select("path", "kind", "oid", "byte_length").unionByName(problems.select("path", "kind", none.cast("string").alias("oid"), none.cast("long").alias("byte_length")))


@query(f"with p as (select path, 'too-large' as kind from ({FILES}) where byte_length > 5000) select count(*) as problems, (select string_agg(path, ',' order by path) from (select path from p order by path limit 3)) as first, greatest(count(*) - 3, 0) as more from p")
def scan_summary(spark, d):
    docs = fx.table(spark, d, "documents")
    name = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.expr("case when doc_id % 29 = 3 then '.md' else '.txt' end")))
    problems = docs.filter(F.octet_length("text") > 5000).select(name.alias("path"), F.lit("too-large").alias("kind"))
    return scan.summarize(problems).select("problems", F.array_join(F.transform("examples", lambda e: e["path"]), ",").alias("first"), "more")


@query("select blob_oid, strlen(text) as length from (select distinct s.oid as blob_oid from saved s left join current c on s.path = c.path where c.path is null or c.oid is distinct from s.oid) join (select distinct sha256(text) as o, text from documents) on o = blob_oid", "saved", "current")
def staged_blobs(spark, d):
    """The blobs that a restore needs, staged outside of the workspace and the store."""
    contents = fx.table(spark, d, "documents").select(F.sha2("text", 256).alias("logical_id"), F.col("text").cast("binary").alias("content")).dropDuplicates(["logical_id"])
    needed = drift.required_blobs(fx.current(spark, d), fx.saved(spark, d))
    return objects.stage(needed, contents, new_folder(spark, "scratch"), "/work/space", "/work/store").select("blob_oid", F.octet_length("content").cast("long").alias("length"))


@query("select path, octet_length(encode(path)) as bytes, lower(path) as folded, row_number() over (order by path) as ord from (select distinct source || '/' || lang as path from documents)")
def path_orders(spark, d):
    p = fx.table(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("path")).distinct()
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(paths.utf16_key(F.col("path"))))
    return p.select("path", F.octet_length("path").cast("long").alias("bytes"), paths.git_key(F.col("path"), F.lit(True)).alias("folded"), place.cast("long").alias("ord"))


@query("select c_custkey as id, case when c_custkey % 4 = 0 then null else '/stores/' || sha256('/home/' || c_name) end as path from customer")
def store_paths(spark, d):
    workspace_ = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("/home//"), "c_name")).otherwise(F.concat(F.lit("/home/"), "c_name"))
    return fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), paths.store_path(F.lit("/stores/"), workspace_).alias("path"))


@query("select c_custkey as id, c_custkey % 3 = 0 or c_custkey % 3 = 1 and c_custkey % 2 = 0 as at_or_below, c_custkey % 5 > 0 as oid from customer")
def path_predicates(spark, d):
    c = fx.table(spark, d, "customer")
    path = F.expr("case c_custkey % 3 when 0 then 'a/b' when 1 then if(c_custkey % 2 = 0, 'a/b/c', 'a/bc') else 'a' end")
    name = F.expr("case when c_custkey % 5 > 0 then sha2(c_name, 256) else upper(sha2(concat(c_name, 'f'), 256)) || 'g' end")
    return c.select(F.col("c_custkey").alias("id"), paths.at_or_below(path, F.lit("a/b")).alias("at_or_below"), paths.is_oid(name).alias("oid"))


LF = "chr(10)"
#: A tree of two files and its documents, as SQL text; p is the second path, f the format.
FILE = """'{{"path":"{0}","type":"regular","blobOid":"' || sha256({1}) || '","recreationMode":420}}'"""
ENTRIES = f"""{FILE.format("a/' || o_orderkey || '", "'x'")} || ',' || {FILE.format("' || case o_orderkey % 5 when 0 then rtrim(repeat('b/', 300), '/') when 1 then 'a/../b' else 'b' end || '", "'y'")}"""
DOCUMENT = f"""case when f <= 2 then '{{"format":"snapweave-tree-v' || f || '","entries":[' || e || '],"scope":{{"kind":"all-managed"}}}}' else '{{"format":"snapweave-tree-v9"}}' end || {LF}"""
TREES = f"select *, {DOCUMENT} as document from (select o_orderkey, 1 + o_orderkey % 3 as f, o_orderkey % 5 as p, {ENTRIES} as e from orders)"
NODE = f"""'{{"kind":"snapweave-tree-node","version":1,"level":0,"entries":[' || e || ']}}' || {LF}"""
SCOPE = f"""'{{"kind":"snapweave-tree-scope","version":1,"scopeKind":"all-managed"}}' || {LF}"""
ROOT = f"""'{{"kind":"snapweave-tree-root","version":1,"format":"snapweave-tree-v3","profile":"snapweave-prolly-key-v1","height":0,"entryCount":2,"entryMapRoot":"' || sha256({NODE}) || '","scopeOid":"' || sha256({SCOPE}) || '"}}' || {LF}"""


@query(
    f"""select old_oid, outcome, reason, case when outcome = 'upgraded' then sha256({ROOT}) end as new_oid from (select sha256(document) as old_oid, e,
      case when o_orderkey % 7 = 0 or p = 1 and f < 3 then 'corrupt' when f = 3 then 'unrecognised' when p = 0 and f = 1 then 'format-incompatible' when p = 0 then 'corrupt' else 'upgraded' end as outcome,
      case when o_orderkey % 7 = 0 then 'digest' when f = 3 then 'unrecognised' when p = 1 then 'path' when p = 0 then 'path-limit' end as reason from ({TREES}))"""
)
def tree_upgrades(spark, d):
    spelled = ENTRIES.replace("sha256('x')", "sha2('x', 256)").replace("sha256('y')", "sha2('y', 256)").replace("rtrim(repeat('b/', 300), '/')", "trim(trailing '/' from repeat('b/', 300))")
    made = fx.table(spark, d, "orders").select("o_orderkey", F.expr("1 + o_orderkey % 3").alias("f"), F.expr(spelled).alias("e")).withColumn("document", F.expr(DOCUMENT))
    stored = made.select(F.sha2("document", 256).alias("oid"), F.expr("case when o_orderkey % 7 = 0 then concat(document, ' ') else document end").cast("binary").alias("document"))
    return trees.upgrade(stored).select("old_oid", "outcome", "reason", "new_oid")


@query("select 'excluded-entry' as rule, path from saved where path in (select path from excluded) union all select 'missing-source', path from current where path not in (select path from saved)", "saved", "current", "excluded")
def scope_agreement(spark, d):
    shut = fx.excluded(spark, d).select("path", F.lit(False).alias("m"))
    entries = fx.saved(spark, d).join(shut, "path", "left").select("path", F.coalesce("m", F.lit(True)).alias("managed"))
    return trees.scope_agreement(entries, fx.current(spark, d).select("path", F.lit(True).alias("managed")))


@query("select doc_id, case when doc_id % 3 = 0 then null else strlen(text) end as length from documents")
def strict_base64(spark, d):
    docs = fx.table(spark, d, "documents")
    coded = F.regexp_replace(F.base64(F.col("text").cast("binary")), "\\s", "")
    spelled = F.when(F.col("doc_id") % 3 == 0, F.concat(coded, F.lit("="))).otherwise(coded)
    return docs.select("doc_id", F.octet_length(trees.canonical_base64(spelled)).cast("long").alias("length"))


@query("""select c_custkey as id, c_name as path, case when c_custkey % 2 = 0 then c_name else '"' || c_name || '\\\\x"' end as shown from customer""")
def shown_paths(spark, d):
    c = fx.table(spark, d, "customer")
    raw = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("\\x")))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("path"), trees.display_path(raw).alias("shown"))


# further operators, a row for each of the tables' rows


@query("select c_custkey as id, case when c_custkey % 5 = 0 then 'own' when c_custkey % 3 = 0 then 'all' else 'default' end || '-' || c_custkey as value from customer")
def settings_overlay(spark, d):
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("name"))
    layer = lambda tag, n: c.filter(F.col("name") % n == 0).select("name", F.concat(F.lit(tag), "name").alias("value"))
    extra = spark.createDataFrame([(-1, "unknown")], "name long, value string")
    return planning.overlay(layer("default-", 1), layer("all-", 3), layer("own-", 5).unionByName(extra)).select(F.col("name").alias("id"), "value")


@query(
    """select c_custkey as id, case c_custkey % 6 when 0 then true when 1 then true when 2 then c_custkey % 4 < 2 when 3 then true when 4 then false else c_custkey % 4 = 0 end as relevant from customer"""
)
def ignore_relevance(spark, d):
    path = F.expr("case c_custkey % 6 when 0 then '.gitignore' when 1 then 'a/.gitignore' when 2 then 'ab/.gitignore' when 3 then 'a/b/.gitignore' when 4 then 'a/ignore' else 'x/.gitignore' end")
    prefix = F.expr("case when c_custkey % 6 = 2 then if(c_custkey % 4 < 2, 'ab/c', 'a') when c_custkey % 6 = 5 then if(c_custkey % 4 = 0, '', 'a') else 'a' end")
    return fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), trees.source_is_relevant(path, prefix).alias("relevant"))


@query("select session_id, not bool_or(coalesce(ord = 2 and session_id % 4 = 0, false)) as extends from graph where ord < 5 group by session_id", "graph")
def coordinates_extension(spark, d):
    """The first coordinates of each session against the session, in some of which the third has another type."""
    g = graph(spark, d).join(fx.entries(spark, d).select("session_id", "entry_id", "type", "role"), ["session_id", "entry_id"]).withColumnRenamed("ord", "pos")
    now = g.withColumn("type", F.when((F.col("pos") == 2) & (F.col("session_id") % 4 == 0), "other").otherwise(F.col("type")))
    return sessions.coordinates_extend(g.filter("pos < 5"), now)


@query(
    """, proven as (select session_id, entry_id from graph where stable_parent_id is null union all select g.session_id, g.entry_id from graph g join proven p on p.session_id = g.session_id and p.entry_id = g.stable_parent_id where g.entry_id % 13 <> 0)
    select session_id + 1000000 as session_id, entry_id from proven""",
    "graph",
)
def fork_proven(spark, d):
    """A fork that has all of its source's coordinates, some below another parent: what hangs on those is not proven."""
    g = graph(spark, d)
    parent = F.expr("case when entry_id % 13 = 0 and stable_parent_id is not null then -1 else stable_parent_id end")
    return planning.proven(g, g.select((F.col("session_id") + 1000000).alias("session_id"), F.col("session_id").alias("source_session"), "entry_id", parent.alias("stable_parent_id"), "ord"))


BODY = f"(7 + {VARINT.format('r')} + case when r > 0 then b + r * {VARINT.format('b')} else 0 end)"


@query(
    f"""select id, cast({BODY} + 6 + {VARINT.format('r')} * 257 + r * (42 + {VARINT.format('greatest(0, r - 1)')} + {VARINT.format(BODY)} * 2) + 72 as bigint) as bound
    from (select o_orderkey as id, cast(o_orderkey % 65536 as bigint) as r, cast(o_custkey as bigint) * 977 as b from orders)"""
)
def pack_size_bounds(spark, d):
    o = fx.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), compaction.pack_bytes_bound((F.col("o_orderkey") % 65536).cast("long"), F.col("o_custkey").cast("long") * 977).alias("bound"))


KIND = "case c_custkey % 6 when 0 then 'content' when 1 then 'recipe' when 2 then 'tree-root' when 3 then 'tree-node' when 4 then 'scope' else 'other' end"
ENCODING = "case c_custkey % 5 when 0 then 'raw' when 1 then 'zstd-v1' when 2 then 'delta1' when 3 then 'chunked-v1' else 'lzma' end"


@query(
    f"""select id, case when kind = 'content' then 'data' when kind <> 'other' then 'metadata' end as class, kind <> 'other' and (encoding in ('raw', 'zstd-v1') or kind = 'content' and encoding <> 'lzma') as compatible
    from (select c_custkey as id, {KIND} as kind, {ENCODING} as encoding from customer)"""
)
def record_kinds(spark, d):
    kind, encoding = F.expr(KIND), F.expr(ENCODING)
    return fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), objects.pack_class(kind).alias("class"), objects.compatible(kind, encoding).alias("compatible"))


@query("select 'c' || (s_nationkey % 2) as class, count(*) as records, cast(sum(s_suppkey * 37 % 1000) as bigint) as bytes from supplier group by all")
def gc_plan_metrics(spark, d):
    own = fx.table(spark, d, "supplier").selectExpr("concat('c', s_nationkey % 2) as class", "sha2(cast(s_suppkey as string), 256) as key", "s_suppkey * 37 % 1000 as length")
    none = own.select(F.col("key").alias("target_id"), F.col("key").alias("base_id")).limit(0)
    return compaction.plan_metrics(compaction.plan(own, none, 5000)[0], own).select("class", "records", "bytes")


@query(
    """with k as (select distinct 'k' || (l_partkey % 40) as key from lineitem where l_suppkey % 2 = 0), g as (select 'k' || (l_partkey % 60) as key, max(100 + l_partkey % 60) as n from lineitem group by all)
    select key from k union all select key from g where key not in (select key from k) and (select sum(n) from g where key not in (select key from k)) <= 8000"""
)
def gc_tier_extension(spark, d):
    rows = fx.table(spark, d, "lineitem")
    selected = rows.filter("l_suppkey % 2 = 0").select(F.expr("concat('k', l_partkey % 40)").alias("key")).distinct()
    group = rows.select(F.expr("concat('p', l_suppkey)").alias("pack_id"), F.expr("concat('k', l_partkey % 60)").alias("key"), F.expr("100 + l_partkey % 60").alias("decoded_length"))
    return compaction.extend_with_tier(selected, group, 2000, 10_000)


@query("""select c_custkey as id, '{"b":' || c_custkey || ',"a":["x","é",null]}' || chr(10) as document from customer""")
def canonical_documents(spark, d):
    c = fx.table(spark, d, "customer")
    loose = F.concat(F.lit('{ "b" : '), F.col("c_custkey").cast("string"), F.lit(',\t"a": ["x", "\\u00e9", null ]}  '))
    return c.select(F.col("c_custkey").alias("id"), trees.canonical_json(loose).alias("document"))


@query(
    """select case c_custkey % 5 when 0 then 'not-archived' when 1 then 'other-content' else 'not-managed' end as rule, 'd' || c_custkey || '/.gitignore' as path from customer where c_custkey % 5 in (0, 1, 2)"""
)
def scope_bindings(spark, d):
    """Ignore files in folders by customer: some not archived, some of other bytes, some archived only."""
    c = fx.table(spark, d, "customer").withColumn("path", F.expr("concat('d', c_custkey, '/.gitignore')"))
    oid = F.sha2("c_name", 256)
    entries = c.filter("c_custkey % 5 <> 2").select("path", oid.alias("oid")).unionByName(c.select(F.concat(F.lit("f/"), "c_name").alias("path"), oid.alias("oid")))
    return planning.scope_bindings(entries, c.filter("c_custkey % 5 <> 0").select("path", F.when(F.col("c_custkey") % 5 == 1, F.sha2(F.lit("x"), 256)).otherwise(oid).alias("oid")))


@query(
    """select case c_custkey % 7 when 0 then 'not-canonical' when 1 then 'not-a-source' else 'duplicate' end as rule, c_nationkey as scope,
      'd' || c_custkey || case when c_custkey % 7 = 1 then '/ignore' else '/.gitignore' end as path from customer where c_custkey % 7 in (0, 1, 2)"""
)
def scope_problems(spark, d):
    c = fx.table(spark, d, "customer")
    path = F.concat(F.lit("d"), F.col("c_custkey").cast("string"), F.expr("if(c_custkey % 7 = 1, '/ignore', '/.gitignore')"))
    coded = F.concat(F.base64(F.col("c_custkey").cast("string").cast("binary")), F.expr("if(c_custkey % 7 = 0, ' ', '')"))
    rows = c.select(F.col("c_nationkey").alias("scope"), path.alias("path"), coded.alias("contents"), "c_custkey")
    again = rows.filter("c_custkey % 7 = 2").withColumn("path", F.concat(F.lit("D"), F.substring("path", F.lit(2), F.char_length("path"))))
    return trees.scope_problems(rows.unionByName(again).drop("c_custkey"))


@query(
    """with p as (select logical_id, pack_id, "offset", length from (select logical_id, pack_id, row_number() over (partition by pack_id order by logical_id) as "offset", length from pack_entry)),
    w as (select logical_id, any_value(h) as hinted from (select logical_id, false as h from p union all select 'none-' || n_nationkey, false from nation) group by all)
    select w.logical_id, min(struct_pack(p := p.pack_id, o := p."offset", l := p.length)).p as pack_id, coalesce(bool_or(p.pack_id < '8'), false) as hinted from w left join p using (logical_id) group by w.logical_id""".replace("with p", "select * from (with p", 1) + ")",
    "pack_entry",
)
def located_records(spark, d):
    """An index that knows the packs below 8, right for all of these, wrong for none; the rest is found in the footers."""
    own = fx.pack_entries(spark, d).withColumn("offset", F.row_number().over(Window.partitionBy("pack_id").orderBy("logical_id")))
    footers = own.select("logical_id", "pack_id", "offset", "length")
    wanted = footers.select("logical_id").distinct().unionByName(fx.table(spark, d, "nation").select(F.expr("concat('none-', n_nationkey)").alias("logical_id")))
    return objects.locate(wanted, footers.filter("pack_id < '8'"), footers).select("logical_id", "pack_id", "hinted")
