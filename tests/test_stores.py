"""Settings, scopes, metadata databases, histories with cycles, budgets and staging: small cases and what must be refused."""

import hashlib
import json
import os
import sqlite3
import subprocess

import pytest
from pyspark.sql import functions as F

from snapweave.functions import paths
from snapweave.operators import chunks, compaction, drift, formats, history, manifest, metadata, planning, storage
from snapweave.plans import registry
from snapweave.sources import objects, scope, settings
from snapweave.streaming import observer


def oid(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_settings(tmp_path):
    read = lambda x, workspace=False: settings.parse(json.dumps(x).encode(), workspace)
    assert read({"maxFileMiB": 0.5, "maxEntries": 7, "gc": {"intervalMs": 0}, "locale": "en", "unknown": 1, "storageDir": "~/x"}) == {"maxFileBytes": 1 << 19, "maxEntries": 7, "autoGcIntervalMs": 0, "locale": "en", "storageDir": "~/x"}
    for bad in ([], {"maxFileMiB": 0}, {"maxFileMiB": "1"}, {"maxEntries": 1.5}, {"maxEntries": 1_000_001}, {"maxManifestMiB": 257}, {"maxPathBytes": True}, {"lockTimeoutMs": 0}, {"locale": "fr"}, {"gc": 1}, {"gc": {"intervalMs": -1}}, {"storageDir": " "}):
        with pytest.raises(settings.SettingsError):
            read(bad)
    for name in settings.GLOBAL_ONLY:
        with pytest.raises(settings.SettingsError):
            read({name: "en"}, True)
    for data in (b"\xff", b"{", b""):
        with pytest.raises(settings.SettingsError):
            settings.parse(data)
    (tmp_path / "all.json").write_text('{"maxEntries": 5, "locale": "en"}')
    (tmp_path / "own.json").write_text('{"maxEntries": 9, "maxPathComponents": 3}')
    made = settings.load(f"file://{tmp_path}/all.json", f"file://{tmp_path}/own.json")
    assert (made["maxEntries"], made["locale"], made["maxPathComponents"], made["maxPathBytes"]) == (9, "en", 3, 65_536)
    assert settings.load(f"{tmp_path}/none.json") == settings.DEFAULTS


def test_schedule(tmp_path):
    uri = f"file://{tmp_path}/schedule.json"
    assert settings.last_run(uri) == 0
    settings.write_last_run(uri, 1234)
    assert settings.last_run(uri) == 1234 and (tmp_path / "schedule.json").read_bytes() == b'{"lastGcAt":1234}\n' and os.listdir(tmp_path) == ["schedule.json"]
    with pytest.raises(settings.SettingsError):
        settings.write_last_run(uri, -1)
    for bad in ("{}", '{"lastGcAt": -1}', '{"lastGcAt": 1, "x": 2}', "x"):
        (tmp_path / "schedule.json").write_text(bad)
        with pytest.raises(settings.SettingsError):
            settings.last_run(uri)


def test_scope_of_a_work_tree(tmp_path, monkeypatch):
    home = tmp_path / "home"
    (home / ".config" / "git").mkdir(parents=True)
    (home / ".config" / "git" / "ignore").write_text("*.bak\n")
    monkeypatch.setenv("HOME", str(home))
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
    plain = tmp_path / "plain"
    plain.mkdir()
    assert scope.discover(str(plain)) == (str(plain.resolve()), None, formats.ALL_MANAGED)
    top = tmp_path / "repo"
    (top / "a" / "b").mkdir(parents=True)
    subprocess.run(["git", "init", "-q", str(top)], check=True)
    (top / ".gitignore").write_text("dist/\n")
    (top / "a" / "b" / ".gitignore").write_text("own\n")
    (top / ".git" / "info" / "exclude").write_text("private\n")
    subprocess.run(["git", "-C", str(top), "config", "core.ignoreCase", "true"], check=True)
    real, repository, found = scope.discover(str(top / "a" / "b"))
    text = lambda b: formats.base64.b64encode(b).decode()
    assert (real, repository) == (str((top / "a" / "b").resolve()), str(top.resolve()))
    assert found["repositoryPrefix"] == "a/b" and found["ignoreCase"] and found["evaluator"]["version"].startswith("git version")
    assert found["gitignoreSources"] == [{"path": ".gitignore", "contentsBase64": text(b"dist/\n")}]
    assert (found["infoExcludeBase64"], found["globalExcludeBase64"]) == (text(b"private\n"), text(b"*.bak\n"))
    assert scope.source_in(repository, found, "") == {"path": "a/b/.gitignore", "contentsBase64": text(b"own\n")} and scope.source_in(repository, found, "c") is None
    assert scope.source_in(repository, dict(formats.ALL_MANAGED), "") is None and scope.ancestors("x/y") == [".gitignore", "x/.gitignore"]
    (top / ".gitignore").write_bytes(b"x" * (formats.SOURCE_BYTES + 1))
    with pytest.raises(scope.ScopeError):
        scope.discover(str(top / "a"))


def database(path, version=metadata.VERSION, tables=metadata.TABLES):
    db = sqlite3.connect(path)
    for sql in tables.values():
        db.execute(sql)
    db.execute(f"pragma user_version = {version}")
    return db


def test_metadata_databases(spark, tmp_path):
    path = str(tmp_path / "meta.db")
    db = database(path)
    db.executemany("insert into session_registry values (?, ?, ?)", [("s", "f", "verified"), ("t", "g", "pending")])
    db.execute("insert into checkpoint_slot values ('s', 'e', null, 'blocked')")
    db.commit()
    tables = metadata.read(spark, path)
    assert rows(tables["session_registry"]) == [("s", "f", "verified"), ("t", "g", "pending")] and rows(tables["checkpoint_slot"]) == [("s", "e", None, "blocked")] and tables["session_capture_barrier"].count() == 0
    told = {k: metadata.inspect(path, *k) for k in (("s", "f"), ("s", "g"), ("u", "h"), ("s", "h"), ("u", "g"))}
    assert told == {("s", "f"): "exact", ("s", "g"): "conflict", ("u", "h"): "absent", ("s", "h"): "conflict", ("u", "g"): "conflict"}
    db.execute("create table stray(x)")
    db.commit()
    assert metadata.inspect(path, "s", "f") == "unrecognized" and metadata.schema_problems(db) == [("stray", "unexpected")]
    with pytest.raises(ValueError, match="stray"):
        metadata.read(spark, path)
    db.execute("pragma user_version = 9")
    db.commit()
    assert metadata.inspect(path, "s", "f") == "newer"
    (tmp_path / "meta.db-journal").write_bytes(b"x")
    assert metadata.inspect(path, "s", "f") == "recovery-required"
    other = database(str(tmp_path / "other.db"), 2, {**metadata.TABLES, "session_registry": "create table session_registry(session_id text)"})
    assert metadata.schema_problems(other) == [("", "version"), ("session_registry", "other")]
    assert metadata.normalized_sql(" a  ( 'x ,  y' ,\n[b  c] ) ") == "a('x ,  y',[b  c])" and metadata.normalized_sql(None) == ""
    metadata.register_writer_protocol(spark, "store_writer_protocol")
    assert spark.sql("select store_writer_protocol() = 3").first()[0]
    with pytest.raises(ValueError):
        metadata.register_writer_protocol(spark, "x; drop")


def test_cycles_are_errors(spark):
    df = lambda x: spark.createDataFrame(x, "session_id long, entry_id long, parent_id long, ord long, type string, role string")
    loop = df([(1, 1, 2, 0, "label", None), (1, 2, 1, 1, "label", None), (1, 3, 1, 2, "message", "user")])
    with pytest.raises(ValueError, match="cycle"):
        history.stable_graph(loop).collect()
    graph = spark.createDataFrame([(1, 1, 2, 0), (1, 2, 1, 1), (1, 3, 2, 2)], "session_id long, entry_id long, stable_parent_id long, ord long")
    leaves = graph.filter("entry_id = 3")
    for run in (lambda: history.ancestry(graph), lambda: history.depths(graph), lambda: history.above(graph, leaves), lambda: history.reach_up(graph, leaves.withColumn("steps", F.lit(5).cast("long")))):
        with pytest.raises(ValueError, match="cycle"):
            run().collect()
    with pytest.raises(ValueError, match="cycle"):
        history.nearest_checkpoint(graph, spark.createDataFrame([], "session_id long, entry_id long, tree_oid string")).collect()


def test_deep_chains_have_a_row_an_entry(spark):
    n = 100_001
    chain = spark.range(n).select(F.lit(1).cast("long").alias("session_id"), F.col("id").alias("entry_id"), F.expr("case when id > 0 then id - 1 end").alias("stable_parent_id"), F.col("id").alias("ord"))
    leaf = chain.filter(f"entry_id = {n - 1}")
    assert history.above(chain, leaf).count() == n
    asked = spark.createDataFrame([(1, n - 1, n - 1), (1, 500, 499), (1, 500, 501), (1, 7, 0)], "session_id long, entry_id long, steps long")
    assert rows(history.reach_up(chain, asked)) == sorted([(1, n - 1, n - 1, 0), (1, 500, 499, 1), (1, 500, 501, None), (1, 7, 0, 7)], key=repr)
    slots = spark.createDataFrame([(1, 50, None, "blocked"), (1, 10, oid("t"), "open")], "session_id long, entry_id long, tree_oid string, capture_state string")
    moves = spark.createDataFrame([(1, 60, n - 1, "capture"), (1, 40, n - 1, "capture"), (1, 50, 50, "capture"), (1, 0, 50, "capture"), (1, 0, None, "capture"), (1, 70, 60, "capture"), (1, None, 5, "write-protected"), (1, None, 5, "capture")], "session_id long, source_id long, target_id long, source_kind string")
    told = {(r.source_id, r.target_id, r.source_kind): r.outcome for r in history.navigation(moves, chain, slots, history.resolve(chain, slots)).collect()}
    assert told == {
        (60, n - 1, "capture"): "inherit-source", (40, n - 1, "capture"): "restore", (50, 50, "capture"): "same-location", (0, 50, "capture"): "protected-missing", (0, None, "capture"): "no-node",
        (70, 60, "capture"): "restore", (None, 5, "write-protected"): "protected-missing", (None, 5, "capture"): "materialize-missing",
    }


def test_renamed_directories(spark):
    entry = "path string, kind string, oid string, target string"
    df = lambda *p: spark.createDataFrame([(x, "regular", oid(x), None) for x in p], entry)
    now, want = df("Src/Lib/a", "Src/b", "docs/x\n"), df("src/lib/a", "src/b", "docs/x\n", "éa/f")
    assert rows(drift.renames(now, want)) == [("Src", "src"), ("Src/Lib", "src/lib")]
    assert rows(drift.renames(df("P/q/a"), df("p/q/a"))) == [("P", "p")]
    lines = [r.line for r in drift.preview(now, want).orderBy("r", "ord").collect()]
    assert lines == ["- Src/Lib/a", "- Src/b", "> Src → src", "> Src/Lib → src/lib", "+ src/b", "+ src/lib/a", "+ éa/f"]
    told = drift.summary(now, want).first()
    assert (told.renamed, told.actions, told.unchanged, told.has_changes) == (2, 7, 1, True)
    order = [(r.step, r.path) for r in drift.apply_order(now, want).collect()]
    assert order[:2] == [(0, "src"), (0, "src/lib")] and {s for s, _ in order} == {0, 1, 2, 3, 4}
    odd = spark.createDataFrame([("\U0001f600",), ("ﬁ",), ("a",)], "path string")
    assert [r[0] for r in odd.orderBy(paths.utf16_key(F.col("path"))).collect()] == ["a", "\U0001f600", "ﬁ"]
    assert paths.message_of(ValueError("x")) == "x" and paths.message_of(7) == "7"

    class Hostile(Exception):
        def __str__(self):
            raise RuntimeError

    assert paths.message_of(Hostile("a", "b")) == "unprintable failure"


def test_additive_capacity(spark):
    base = {"new_records": 2, "new_packs": 1, "largest_incoming_bytes": 64, "current_objects": 8, "current_index_entries": 8, "current_packs": 2, "current_incoming_files": 0, "current_incoming_bytes": 0, "max_objects": 10, "max_index_entries": 10, "max_packs": 3, "max_incoming_files": 1, "max_incoming_bytes": 64}
    cases = [({}, True), ({"current_index_entries": 9}, False), ({"current_packs": 3}, False), ({"current_incoming_files": 1}, False), ({"current_incoming_bytes": 1}, False), ({"current_objects": 9}, False), ({"new_packs": 0, "current_incoming_files": 1}, True), ({"new_records": -1}, False)]
    df = spark.createDataFrame([tuple({**base, **x}.values()) for x, _ in cases], ", ".join(f"{k} long" for k in base))
    assert [r[0] for r in df.select(storage.additive_capacity()).collect()] == [ok for _, ok in cases]


def test_budgets_preflight_and_closures(spark):
    df = spark.createDataFrame
    changes = df([("s", 1, "a", 10), ("s", 2, "b", 20), ("s", 3, "a", 5), ("s", 4, "c", 90), ("s", 5, "c", 1), ("t", 1, "x", 1)], "scope string, seq long, path string, bytes long")
    assert rows(planning.policy_budget(changes, 3, 100)) == [("s", 3, 26, 4), ("t", 1, 1, None)]
    assert rows(planning.policy_budget(changes, 2, 1000)) == [("s", 3, 26, 4), ("t", 1, 1, None)]
    edges, sizes = df([("t", "a"), ("t", "a"), ("u", "b"), ("u", "c")], "tree_id string, blob_id string"), df([("a", 60), ("b", 1)], "blob_id string, length long")
    assert rows(manifest.import_preflight(edges, sizes, 100)) == [("t", "over-quota"), ("u", "missing-blob")] and manifest.import_preflight(edges.filter("tree_id = 't'"), sizes, 120).isEmpty()
    lengths = df([(k, 1) for k in "crxyz"], "logical_id string, length long")
    recipe = df([("c", "r"), ("r", "x"), ("r", "y"), ("c", "x")], "parent_id string, child_id string")
    assert rows(storage.closures(df([("c",), ("z",)], "content_id string"), recipe, lengths)) == [("c", 4, 4), ("z", 1, 1)]
    with pytest.raises(ValueError, match="deep"):
        storage.closures(df([("n0",)], "content_id string"), df([(f"n{k}", f"n{k + 1}") for k in range(12)], "parent_id string, child_id string"), lengths, most=5)
    slots = df([("s", "e", "x"), ("s", "f", "y"), ("s", "g", "x"), ("s", "h", None)], "session_id string, entry_id string, tree_oid string")
    assert [r[0] for r in planning.roots(slots, 2).collect()] == ["x", "y"]
    with pytest.raises(Exception, match="more than 1"):
        planning.roots(slots, 1).collect()


def test_roots_beyond_a_page(spark, tmp_path):
    slots = spark.createDataFrame([(x,) for x in ["x", "y", "x", None, "a", "z", "b"]], "tree_oid string")
    for most, want in ((1, [0, 1, 2, 3, 4]), (2, [0, 0, 1, 1, 2]), (5, [0] * 5), (6, [0] * 5)):
        assert rows(planning.root_pages(slots, most)) == list(zip(want, "abxyz", strict=True))
    assert planning.root_pages(slots.limit(0), 2).isEmpty()
    with pytest.raises(ValueError, match="page"):
        planning.root_pages(slots, 0)
    events = spark.range(1_000_001).selectExpr("id as event_id", "id % 9 as user_id", "if(id = 3, 'signup', 'purchase') as event_type").union(spark.range(1_000_001, 1_000_004).selectExpr("id", "id", "'purchase'"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = [r[0] for r in registry.gc_roots_bounded(spark, str(tmp_path)).collect()]
    assert len(got) == 1_000_003 and got == sorted({hashlib.sha256(str(i).encode()).hexdigest() for i in range(1_000_004) if i != 3})


def test_staging(spark, tmp_path):
    needed = spark.createDataFrame([(oid("a"),), (oid("b"),), (oid("a"),)], "blob_oid string")
    held = spark.createDataFrame([(oid("a"), b"a"), (oid("b"), b"b"), (oid("c"), b"c")], "logical_id string, content binary")
    assert rows(objects.stage(needed, held, f"file://{tmp_path}/scratch", "/work")) == sorted([(oid("a"), b"a"), (oid("b"), b"b")], key=repr)
    with pytest.raises(ValueError, match="lies in"):
        objects.stage(needed, held, "/work/space/tmp", "/work/space")
    for lost in (held.filter(F.col("logical_id") != oid("b")), held.withColumn("content", F.encode(F.lit("z"), "utf-8"))):
        with pytest.raises(Exception, match="no intact blob"):
            objects.stage(needed, lost, f"file://{tmp_path}/scratch-{id(lost)}")


def test_streams_of_pieces(spark):
    data = bytes(range(256)) * 2000
    pieces = [(k, i, data[a : a + n]) for k, n in (("x", 100_000), ("y", 7_777)) for i, a in enumerate(range(0, len(data), n))] + [("none", 0, b""), ("null", 0, None)]
    df = spark.createDataFrame(pieces, "content_id string, ord long, piece binary").repartition(5)
    made = chunks.chunk_pieces(df).orderBy("content_id", "ord").collect()
    whole = [len(c) for c in chunks.pieces(data)]
    assert [r.length for r in made if r.content_id == "x"] == whole == [r.length for r in made if r.content_id == "y"] and {r.content_id for r in made} == {"x", "y"}
    digest = hashlib.sha256(data).hexdigest()
    assert rows(chunks.digests(df)) == sorted([("x", digest, len(data)), ("y", digest, len(data)), ("none", oid(""), 0), ("null", oid(""), 0)], key=repr)


def test_logs_read_again(spark):
    shape = "session_id long, entry_id long, parent_id long, ord long, type string, role string"
    log = lambda s, n, **odd: [(s, 10 * s + k, 10 * s + k - 1 if k else None, k, odd.get(f"t{k}", "message"), None) for k in range(n)]
    before = spark.createDataFrame([*log(1, 3), *log(2, 3), *log(3, 3), *log(4, 3), *log(6, 2)], shape)
    now = spark.createDataFrame([*log(1, 3), *log(2, 5), *log(3, 4, t1="label"), *log(4, 2), *log(5, 2), (6, 60, None, 0, "message", None), (6, 61, 60, 1, "message", None), (6, 62, 99, 2, "message", None)], shape)
    assert rows(observer.reobserve(before, now)) == [(1, "unchanged", 0), (2, "appended", 2), (3, "re-read", 4), (4, "re-read", 2), (5, "new", 2), (6, "re-read", 3)]
    assert rows(observer.reobserve(before, now.limit(0)))[0] == (1, "gone", 0)


def test_large_contents_are_converted(spark):
    data = os.urandom(300_000)
    contents = spark.createDataFrame([(hashlib.sha256(data).hexdigest(), data), (oid("small"), b"small")], "content_id string, content binary")
    found, recipes, roots = compaction.convert_large(contents)
    root = roots.first()
    assert root.decoded_length == 300_000 and found.agg(F.sum("length")).first()[0] == 300_000
    edges, bad = chunks.recipe_edges(recipes)
    flat = planning.flatten_recipes(roots.select("content_id", F.col("recipe_id").alias("node_id")), edges).orderBy("ord").collect()
    at = {r.chunk_id: data[r.offset : r.offset + r.length] for r in found.collect()}
    assert bad.isEmpty() and b"".join(at[r.chunk_id] for r in flat) == data
    with pytest.raises(ValueError):
        compaction.collect(None, None, None, None, None, 5, -1)


def test_cycle_rewrites_a_size_tier(spark):
    df = spark.createDataFrame
    packs = [(f"p{k}", "content", f"c{k}", 100 + k, 100 + k) for k in range(6)] + [("big", "content", "z", 5000, 5000), ("half", "content", "x", 10, 10), ("half", "content", "dead", 30, 30)]
    entries = df(packs, "pack_id string, kind string, logical_id string, length long, decoded_length long")
    objects_ = df([("none", False, 9)], "object_id string, temporary boolean, modified long")
    live = df([("t", i) for _, _, i, _, _ in packs if i != "dead"], "tree_oid string, logical_id string")
    reach = lambda roots: live.join(roots, "tree_oid", "left_semi").select(F.lit("content").alias("kind"), "logical_id")
    wrote = []
    run = lambda **x: compaction.cycle(entries, objects_, lambda: df([("t",)], "tree_oid string"), reach, lambda placed, _: wrote.append({r.key: r.batch for r in placed.collect()}), F.lit(5), **x).first()
    told = run()
    # the partial pack's live record, and the first four packs of the lowest tier that has four
    assert wrote[-1] == {f"content:{i}": 0 for i in ("x", "c0", "c1", "c2", "c3")} and told.rewritten_packs == 5
    assert run(budget=200).rewritten_packs == 1 and wrote[-1] == {"content:x": 0}  # the tier does not fit
    assert run(target=50).rewritten_packs == 1  # rewriting would not make fewer packs
    bases = df([("content:c3", "content:c0"), ("content:c1", "content:gone")], "target_id string, base_id string")
    run(bases=bases, target=250)
    assert wrote[-1]["content:c3"] == wrote[-1]["content:c0"]
