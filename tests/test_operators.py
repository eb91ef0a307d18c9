"""Small cases of the operators, among them literal vectors of the storage format."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from snapweave.functions import paths
from snapweave.operators import chunks, compaction, drift, formats, history, manifest, slots, storage
from snapweave.sources import packfile, scan
from snapweave.streaming import observer


def oid(text):
    return hashlib.sha256(text.encode()).hexdigest()


ENTRY = "path string, kind string, oid string, target string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_drift(spark):
    now = spark.createDataFrame([("added.txt", "regular", oid("new"), None), ("changed.txt", "regular", oid("new"), None), ("l", "symlink", None, "a")], ENTRY)
    then = spark.createDataFrame([("changed.txt", "regular", oid("old"), None), ("removed.txt", "regular", oid("gone"), None), ("l", "symlink", None, "a")], ENTRY)
    assert rows(drift.actions(now, then)) == [("created", "removed.txt"), ("deleted", "added.txt"), ("modified", "changed.txt")]
    assert rows(drift.required_blobs(now, then)) == sorted([(oid("old"),), (oid("gone"),)])
    assert "deleted" not in {a for a, _ in rows(drift.actions(now, then, scopes_match=False))}
    assert rows(drift.actions(then, then)) == []
    assert rows(drift.actions(now.limit(0), then.limit(0))) == []
    swapped = then.withColumn("kind", F.when(F.col("path") == "l", "regular").otherwise(F.col("kind")))
    assert rows(drift.actions(swapped, then)) == [("modified", "l")]


def test_apply_order(spark):
    now = spark.createDataFrame([("old/deep/x", "regular", oid("1"), None), ("keep/a", "regular", oid("1"), None)], ENTRY)
    then = spark.createDataFrame([("new/deep/y", "regular", oid("1"), None), ("keep/a", "regular", oid("2"), None)], ENTRY)
    order = [(r.step, r.path) for r in drift.apply_order(now, then).collect()]
    assert order == [(1, "old/deep/x"), (2, "old/deep"), (2, "old"), (3, "new"), (3, "new/deep"), (4, "keep/a"), (4, "new/deep/y")]


def test_blockers_and_aliases(spark):
    then = spark.createDataFrame([("a", "regular", oid("1"), None), ("b/c/d", "regular", oid("1"), None)], ENTRY)
    out = spark.createDataFrame([("a/x/y", "regular"), ("a", "regular"), ("b/c", "directory"), ("bc", "regular")], "path string, kind string")
    assert rows(drift.scope_blockers(out, then)) == [("a", "a"), ("a/x/y", "a"), ("b/c", "b/c")]
    now = spark.createDataFrame([("Σ/Path", 1), ("moved", 2), ("same", 3)], "path string, identity int")
    want = spark.createDataFrame([("σ/path", None), ("was", 2), ("same", 3)], "path string, identity int")
    assert rows(drift.aliases(now, want)) == [("was", "moved", "identity"), ("σ/path", "Σ/Path", "spelling")]


@pytest.mark.parametrize("path, rule", [("a/b", None), ("", "empty"), ("/a", "absolute"), ("a\\b", "unsafe-character"), ("a//b", "unsafe-component"), ("a/..", "unsafe-component"), ("x/.GIT/y", "git-component"), ("a/" * 256 + "b", "too-deep"), ("a" * 65_537, "too-long")])
def test_path_rules(spark, path, rule):
    assert spark.createDataFrame([(path,)], "path string").select(paths.violation(F.col("path"))).first()[0] == rule


def test_path_functions(spark):
    row = spark.createDataFrame([("a/b/c.txt",)], "path string").select(paths.ancestors(F.col("path")), paths.basename(F.col("path")), paths.depth(F.col("path")), paths.at_or_below(F.col("path"), F.lit("a/b")), paths.at_or_below(F.col("path"), F.lit("a/"))).first()
    assert tuple(row) == (["a", "a/b"], "c.txt", 3, True, False)
    assert paths.fold_key("STRASSE") == paths.fold_key("Straße".upper()) and paths.fold_key("é") == paths.fold_key("é")
    sizes = spark.createDataFrame([(n,) for n in (0, 1, 127, 128, 16384, 2**53 - 1)], "n long").select("n", paths.varint_length(F.col("n")).alias("k")).collect()
    assert all(r.k == len(chunks.varint(r.n)) for r in sizes)


def test_manifest(spark):
    df = spark.createDataFrame([("a",), ("a",), ("A",), ("d/e",), ("d",), ("É",), ("é",), ("../x",)], "path string")
    assert rows(manifest.violations(df)) == sorted([("duplicate-path", "a"), ("portable-alias", "a"), ("managed-parent", "d/e"), ("portable-alias", "É"), ("unsafe-component", "../x")], key=repr)


GRAPH = "session_id long, entry_id long, parent_id long, ord long, type string, role string"
SLOT = "session_id long, entry_id long, tree_oid string, capture_state string"


def chain(spark, n, labels=()):
    return spark.range(n).select(F.lit(1).cast("long").alias("session_id"), F.col("id").alias("entry_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.col("id").alias("ord"), F.when(F.col("id").isin(*labels), "label").otherwise("custom").alias("type"), F.lit(None).cast("string").alias("role"))


def test_transparent_entries(spark):
    df = spark.createDataFrame([(1, 0, None, 0, "label", None), (1, 1, 0, 1, "custom", None), (1, 2, 1, 2, "label", None), (1, 3, 2, 3, "label", None), (1, 4, 3, 4, "message", "user"), (1, 5, 2, 5, "unknown-kind", None)], GRAPH)
    assert rows(history.stable_graph(df).drop("ord")) == [(1, 1, None), (1, 4, 1), (1, 5, 1)]
    assert [r.landing for r in history.projection(df).orderBy("entry_id").collect()] == [0, 1, 2, 3, 3, 5]


@pytest.mark.parametrize("own, want", [
    ([("a", "open"), (None, "blocked"), None], (0, "a")),
    ([("a", "open"), ("b", "blocked"), None], (1, "b")),
    ([("a", "open"), (None, "blocked")], (None, None)),
    ([None, None], (None, None)),
])
def test_lineage(spark, own, want):
    graph = history.stable_graph(chain(spark, len(own)))
    table = spark.createDataFrame([(1, i, *s) for i, s in enumerate(own) if s], SLOT)
    last = history.resolve(graph, table).filter(F.col("entry_id") == len(own) - 1).first()
    assert (last.found_at, last.tree_oid) == want


def test_deep_lineage(spark):
    n = 100_001
    found = history.resolve(history.stable_graph(chain(spark, n)), spark.createDataFrame([(1, 0, "a", "open")], SLOT))
    assert found.filter("found_at = 0 and tree_oid = 'a'").count() == n


def test_graph_rules(spark):
    df = spark.createDataFrame([(1, 0, None, 0, "custom", None), (1, 1, 9, 1, "custom", None), (1, 2, 3, 2, "custom", None), (1, 3, 2, 3, "custom", None), (1, 3, 2, 4, "custom", None), (1, 5, 5, 5, "custom", None)], GRAPH)
    assert rows(history.violations(df)) == [("duplicate", 1, 3), ("forward-parent", 1, 2), ("forward-parent", 1, 5), ("unknown-parent", 1, 1)]
    assert rows(history.extends(chain(spark, 3), chain(spark, 5))) == []
    assert rows(history.extends(chain(spark, 5), chain(spark, 3))) == [("lost", 1, 3), ("lost", 1, 4)]


def test_slot_transitions(spark):
    table = spark.createDataFrame([(1, 1, "a", "open"), (1, 2, None, "blocked"), (1, 3, "c", "blocked")], SLOT)
    asked = [(1, i, op, o) for i in range(4) for op, o in (("capture", "n"), ("block", "n"), ("release", "c"), ("adopt", "n"))]
    got = {(r.entry_id, r.op): (r.outcome, r.new_oid, r.new_state) for r in slots.transition(spark.createDataFrame(asked, "session_id long, entry_id long, op string, oid string"), table).collect()}
    assert got[0, "capture"] == ("applied", "n", "open") and got[0, "block"] == ("applied", "n", "blocked")
    assert got[1, "capture"] == ("applied", "n", "open") and got[1, "block"] == ("applied", "a", "blocked")
    assert got[2, "capture"] == ("capture-blocked", None, "blocked") and got[2, "adopt"] == ("applied", "n", "open") and got[2, "block"] == ("applied", None, "blocked")
    assert got[3, "release"] == ("applied", "c", "open") and got[3, "adopt"] == ("not-blocked-missing", "c", "blocked")
    assert {got[i, "release"][0] for i in (0, 1, 2)} == {"checkpoint-mismatch"}


def test_barrier_and_migration(spark):
    graph = history.stable_graph(chain(spark, 3))
    table = spark.createDataFrame([(1, 0, "a", "open"), (1, 1, None, "blocked")], SLOT)
    out = slots.reconcile_barrier(graph, table, history.nearest_checkpoint(graph, table))
    assert rows(out) == [(1, 0, "a", "blocked"), (1, 1, None, "blocked"), (1, 2, "a", "blocked")]
    states = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "session_id long, entry_id long, tree_oid string")
    guards = spark.createDataFrame([(1, 2), (1, 3)], "session_id long, entry_id long")
    assert rows(slots.from_guards(states, guards)) == [(1, 1, "a", "open"), (1, 2, "b", "blocked"), (1, 3, None, "blocked")]


def test_gates(spark):
    df = spark.createDataFrame([(1000, 936), (1000, 937), (2000, 1900), (2000, 1901)], "raw long, packed long")
    assert [r[0] for r in df.select(storage.compression_useful(F.col("raw"), F.col("packed"))).collect()] == [True, False, True, False]
    df = spark.createDataFrame([(10000, 14000), (10000, 14001), (128, 1), (100000, 140000), (100000, 140001)], "t long, s long")
    assert [r[0] for r in df.select(storage.rewrite_worthwhile(F.col("t"), F.col("s"))).collect()] == [True, False, False, True, False]
    cases = [(True, 1, 4, 1000, 5000, 4, 4000), (True, 1, 5, 1000, 5000, 4, 4000), (True, 1, 4, 1000, 5001, 4, 4000), (False, 1, 4, 1000, 5000, 4, 4000)]
    df = spark.createDataFrame(cases, "o boolean, pb long, pa long, bb long, ba long, sp long, sb long")
    assert [r[0] for r in df.select(storage.tier_convergent(*(F.col(c) for c in df.columns))).collect()] == [True, False, False, False]


def test_budget_passes_over_what_does_not_fit(spark):
    df = spark.createDataFrame([("x", "d", 11), ("x", "b", 6), ("x", "a", 5), ("x", "c", None), ("y", "a", 10), ("y", "b", 1), ("y", "c", 0)], "class string, key string, decoded_length long")
    assert rows(storage.admit_within_budget(df, 10)) == [("x", "a"), ("y", "a"), ("y", "c")]


def test_ranking_and_candidates(spark):
    seen = spark.createDataFrame([("src/value.ts", c) for c in ["base"] * 5 + ["one", "two"]], "path string, content_id string")
    size = spark.createDataFrame([("base", 1000), ("one", 1000), ("two", 5000)], "content_id string, decoded_length long")
    ranked = storage.ranked_contents(seen, size)
    assert [(r.content_id, r["rank"]) for r in ranked.orderBy("rank").collect()] == [("base", 1), ("one", 2), ("two", 3)]
    assert rows(storage.delta_candidates(ranked, size).drop("path")) == [("one", "base", 1)]


def test_index_is_independent_of_order(spark):
    entries = [(f"p{p}", oid(f"{p}{k}"), "content", 100 * k + 1) for p in range(3) for k in range(20)]
    df = lambda e: spark.createDataFrame(e, "pack_id string, logical_id string, kind string, length long")
    shuffled = entries[:]
    random.Random(1).shuffle(shuffled)
    assert rows(storage.index_entries(df(entries))) == rows(storage.index_entries(df(shuffled)))
    assert storage.fanout(df(entries)).filter("bucket = 255").first().cumulative == 60


def lcg(n, seed=0x12345678):
    out = bytearray()
    for _ in range(n):
        seed = (seed * 1664525 + 1013904223) & 0xFFFFFFFF
        out.append(seed >> 24)
    return bytes(out)


def test_chunks(spark):
    table = chunks.gear_table()
    # fixed values of the chunking profile
    assert hashlib.sha256(table.astype("<u4").tobytes()).hexdigest() == "bee0cf4dc94f60a1f2135be81664737899efa088ea4ca06d8d848c92da00b3b5"
    data = lcg(1 << 20)
    assert chunks.boundaries(data) == [94469, 70941, 70712, 89051, 37196, 71364, 74862, 67831, 66913, 72733, 86376, 130609, 17352, 85242, 12925]
    assert chunks.boundaries(b"") == [] and chunks.boundaries(b"x") == [1] and chunks.boundaries(bytes(300_000)) == naive(bytes(300_000))
    assert chunks.boundaries(data[5:400_000]) == naive(data[5:400_000])
    df = spark.createDataFrame([("a", data), ("b", None), ("c", b"")], "content_id string, content binary")
    out = chunks.chunk(df).orderBy("ord").collect()
    assert b"".join(data[r.offset : r.offset + r.length] for r in out) == data and all(oid_bytes(data, r) == r.chunk_id for r in out)
    levels = chunks.recipe_levels(spark.range(2000).select(F.lit("x").alias("content_id"), F.col("id").alias("ord"), F.lit(20_000).cast("long").alias("length")))
    assert rows(levels) == [("x", 0, 0, 768, 768 * 20000), ("x", 0, 1, 768, 768 * 20000), ("x", 0, 2, 464, 464 * 20000), ("x", 1, 0, 3, 40_000_000)]


def test_chunks_do_not_depend_on_the_pieces():
    data, rng = lcg(1 << 20) + bytes(700_000) + lcg(400_000, 7), random.Random(1)
    whole = [len(c) for c in chunks.pieces(data)]
    for most in (1, 70_000, 1 << 20):
        chunker, got, at = chunks.Chunker(), [], 0
        while at < len(data):
            n = rng.randint(0, most) if most > 1 else 4999
            got += [len(c) for c in chunker.push(data[at : at + n])]
            assert len(chunker.held) < chunks.MAXIMUM
            at += n
        assert got + [len(c) for c in chunker.finish()] == whole


def test_recipe_objects(spark, monkeypatch):
    from snapweave.operators import planning

    ids = [oid(str(k)) for k in range(2000)]
    leaf = chunks.encode_leaf([(ids[0], 5), (ids[1], 300)])
    assert leaf == b"CYRN\x01\x01\xb1\x02\x02\x01" + bytes.fromhex(ids[0]) + b"\x05\x01" + bytes.fromhex(ids[1]) + b"\xac\x02" and chunks.decode_recipe(leaf) == ("leaf", None, 305, [(ids[0], 5), (ids[1], 300)])
    child = (chunks.recipe_id(leaf), 70_000, 1, 1, 2)
    root = chunks.encode_root(ids[3], child)
    assert root == b"CYRR\x01\x01" + bytes.fromhex(ids[3]) + b"\xf0\xa2\x04\x02" + bytes.fromhex(child[0]) + b"\xf0\xa2\x04\x01\x01\x02" and chunks.decode_recipe(root) == ("root", ids[3], 70_000, [child])
    assert chunks.recipe_id(b"x", "other") == hashlib.sha256(b"other.recipe.v1\0x").hexdigest()
    for broken in (leaf[:-1], leaf + b"\0", b"X" + leaf[1:], leaf[:6] + b"\xb2" + leaf[7:], root[:5] + b"\2" + root[6:], b""):
        with pytest.raises(ValueError):
            chunks.decode_recipe(broken)
    for bad in (lambda: chunks.encode_leaf([]), lambda: chunks.encode_leaf([(ids[0], 1 << 19)]), lambda: chunks.encode_root(ids[0], (ids[1], 65_536, 1, 1, 2)), lambda: chunks.encode_branch([(ids[0], 1, 1, 1, 1), (ids[0], 1, 2, 1, 1)])):
        with pytest.raises(ValueError):
            bad()
    parts = [(oid("c"), k, 20_000, ids[k]) for k in range(2000)] + [(oid("d"), k, 40_000, ids[k]) for k in range(2)] + [(oid("small"), k, 20_000, ids[k]) for k in range(2)]
    made = chunks.recipe_objects(spark.createDataFrame(parts, "content_id string, ord long, length long, chunk_id string")).cache()
    told = sorted((r.content_id, r.level, r.node, r.decoded_length, r.depth, r.nodes, r.chunks) for r in made.collect())
    c, d = oid("c"), oid("d")
    assert told == sorted([(c, 0, 0, 768 * 20000, 1, 1, 768), (c, 0, 1, 768 * 20000, 1, 1, 768), (c, 0, 2, 464 * 20000, 1, 1, 464), (c, 1, 0, 40_000_000, 2, 4, 2000), (c, -1, 0, 40_000_000, 3, 5, 2000), (d, 0, 0, 80_000, 1, 1, 2), (d, -1, 0, 80_000, 2, 2, 2)])
    edges, bad = chunks.recipe_edges(made.select("recipe_id", "document"))
    assert bad.isEmpty()
    roots = made.filter("level = -1").select("content_id", F.col("recipe_id").alias("node_id"))
    flat = planning.flatten_recipes(roots, edges).orderBy("content_id", "ord").collect()
    assert [r.chunk_id for r in flat if r.content_id == c] == ids and [r.chunk_id for r in flat if r.content_id == d] == ids[:2]
    spoilt = made.select("recipe_id", F.when(F.col("level") == 1, F.lit(leaf)).otherwise(F.col("document")).alias("document"))
    assert chunks.recipe_edges(spoilt)[1].count() == 1


def oid_bytes(data, r):
    return hashlib.sha256(data[r.offset : r.offset + r.length]).hexdigest()


def naive(data):
    """A byte at a time."""
    table, out, start = chunks.gear_table().tolist(), [], 0
    while start < len(data):
        rest, value = len(data) - start, 0
        end = min(rest, chunks.MAXIMUM)
        if rest > chunks.MINIMUM:
            for i in range(chunks.MINIMUM, end):
                value = (value << 1) + table[data[start + i]] & 0xFFFFFFFF
                if not value & (chunks.MASK_BEFORE if i < chunks.AVERAGE else chunks.MASK_AFTER):
                    end = i
                    break
        out.append(end)
        start += end
    return out


def test_deltas_and_varints():
    assert chunks.apply_delta(b"abcde", [("copy", 1, 3), ("add", b"!")]) == b"bcd!"
    for n, text in ((0, "00"), (1, "01"), (127, "7f"), (128, "8001"), (16384, "808001"), (2**53 - 1, "ffffffffffffff0f")):
        assert chunks.varint(n).hex() == text and chunks.read_varint(chunks.varint(n)) == (n, len(text) // 2)
    with pytest.raises(ValueError):
        chunks.read_varint(bytes.fromhex("8000"))
    rng = random.Random(6)
    for _ in range(200):
        base = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12)))
        target = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12)))
        steps = chunks.simple_delta(base, target)
        assert steps is None and (not target or base == target) or chunks.apply_delta(base, steps) == target


def published_namespace():
    """The name that the published test vectors were made with, as the fixture notes have it."""
    import pathlib
    import re

    notes = pathlib.Path(__file__).parent.parent / "FIXTURES.md"
    found = re.search(r"fixtures/(\w+)-0\.0\.1-tree", notes.read_text()) if notes.exists() else None
    if not found:
        pytest.skip("no fixture notes")
    return found.group(1)


def file_entry(path, blob, mode=0o644):
    return {"path": path, "type": "regular", "blobOid": blob, "recreationMode": mode}


def test_published_roots():
    """The ids that stores written elsewhere give to the same trees."""
    space = published_namespace()
    files = [file_entry(f"src/file-{i:05d}.ts", f"{i:064x}") for i in range(800)]
    rules = [{"path": f"rules/{i:05d}-{'x' * 512}/.gitignore", "contentsBase64": formats.base64.b64encode(f"ignored-{i}\n".encode()).decode()} for i in range(400)]
    scope = {"kind": "git", "repositoryPrefix": "", "evaluator": {"version": "git version fixture", "precomposeUnicode": False}, "ignoreCase": False, "gitignoreSources": rules, "infoExcludeBase64": "", "globalExcludeBase64": ""}
    for step in (1, -1):
        assert formats.build(*formats.manifest_of(files[::step], formats.ALL_MANAGED, 3), space)[0] == "44d8410ecb551793be0647acda2aca66593612cbfb0eb703516dff621d03a21b"
        assert formats.build(*formats.manifest_of([], {**scope, "gitignoreSources": rules[::step]}, 3), space)[0] == "dc26617bb20f5a2ff9b41c30a8c8818c9d5c0db71fb6f1fb10bf03af85f37951"
    saved = [{"path": "saved-link", "type": "symlink", "target": "saved.txt", "symlinkKind": "file"}, file_entry("saved.txt", "657ac5c3ed8157bd26ba717404992b3a2e7eb771d53dd299c631c637a8aa3f33")]
    old = formats.inline(saved, formats.ALL_MANAGED, 1, space)
    assert formats.oid_of(old) == "0c53042c58202208b41f5cf8fd2b96f7c9f275ba2a38fb4d884831eae5ed5557"
    assert formats.oid_of(formats.inline(*formats.parse(old, space)[1:], 2, space)) == "0500eb0932f28766eda94dfb32673db387e463cb3b56e1eaf6dfb89b1c794568"
    outcome, _, root, objects, contents = formats.upgrade(old, space)
    assert outcome == "upgraded" and formats.read(root, objects.__getitem__, contents.__getitem__, space) == (saved, formats.ALL_MANAGED)


def test_trees_are_authenticated_and_rebuilt():
    base64 = formats.base64
    text = lambda b: base64.b64encode(b).decode()
    ignore = b"dist/\n"
    scope = {"kind": "git", "repositoryPrefix": "pkg", "evaluator": None, "ignoreCase": True, "gitignoreSources": [{"path": ".gitignore", "contentsBase64": text(b"x\n")}, {"path": "pkg/.gitignore", "contentsBase64": text(ignore)}], "infoExcludeBase64": text(b"y"), "globalExcludeBase64": ""}
    entries = [file_entry(".gitignore", oid_of_bytes(ignore)), {"path": "a\u00e9\x01", "type": "symlink", "target": "../t", "symlinkKind": None}, *(file_entry(f"k/{i:05d}", f"{i:064x}", None) for i in range(900))]
    found = formats.manifest_of(entries, scope, 3)
    root, objects, contents = formats.build(*found)
    assert formats.read(root, objects.__getitem__, contents.__getitem__) == found
    assert formats.same_scope(scope, {**scope, "gitignoreSources": scope["gitignoreSources"][::-1]}) and not formats.same_scope(scope, {**scope, "ignoreCase": False})
    for name, data in objects.items():
        for spoilt in (data.replace(b'"level":0', b'"level":1', 1), data[:-3] + b"}\n", b"{}\n"):
            if spoilt == data:
                continue
            with pytest.raises((formats.Invalid, KeyError, ValueError)):
                formats.read(root, {**objects, name: spoilt}.__getitem__, contents.__getitem__)
    # a node of other boundaries, with all ids right, is not what the entries build
    levels = sorted((json_of(d)["level"], k) for k, d in objects.items() if b"tree-node" in d)
    assert levels[-1][0] == 1
    leaf = formats.document({"kind": "snapweave-tree-node", "version": 1, "level": 0, "entries": [formats.stored_entry(e) for e in found[0]]})
    flat = formats.root_document((0, oid_of_bytes(leaf)), len(found[0]), json_of(objects[root])["scopeOid"])
    with pytest.raises(formats.Invalid, match="not-rebuilt"):
        formats.read(oid_of_bytes(flat), {**objects, oid_of_bytes(leaf): leaf, oid_of_bytes(flat): flat}.__getitem__, contents.__getitem__)


def oid_of_bytes(data):
    return hashlib.sha256(data).hexdigest()


def json_of(data):
    import json

    return json.loads(data)


def test_rules_of_each_format():
    one = lambda **x: {**file_entry("a", oid("1")), **x}
    deep, nul = "/".join("a" * 257), formats.base64.b64encode(b"a\0").decode()
    git = {"kind": "git", "repositoryPrefix": "", "ignoreCase": False, "gitignoreSources": [], "infoExcludeBase64": "", "globalExcludeBase64": ""}
    cases = [  # entries, scope, the first format that refuses them (4: none), why
        ([one()], formats.ALL_MANAGED, 4, None),
        ([one(path=deep)], formats.ALL_MANAGED, 2, "path-limit"),
        ([one(path="A\u0130"), one(path="a\u0130")], formats.ALL_MANAGED, 1, "portable-alias"),
        ([one(path="\u017f"), one(path="s")], formats.ALL_MANAGED, 2, "portable-alias"),
        ([one(path="D/x"), one(path="d/y")], formats.ALL_MANAGED, 1, "portable-alias"),
        ([one(path="d"), one(path="d/y")], formats.ALL_MANAGED, 1, "managed-parent"),
        ([one(), one()], formats.ALL_MANAGED, 1, "duplicate-path"),
        ([one(path=".git/x")], formats.ALL_MANAGED, 1, "path"),
        ([one(recreationMode=0o10000)], formats.ALL_MANAGED, 1, "mode"),
        ([one(blobOid="x")], formats.ALL_MANAGED, 1, "entry"),
        ([one(path="e\u0301")], formats.ALL_MANAGED, 1, "path"),
        ([one(path=".gitignore")], git, 1, "source-missing"),
        ([one(path=".GITIGNORE")], git, 2, "source-missing"),
        ([one()], {**git, "infoExcludeBase64": nul}, 3, "nul-byte"),
        ([one()], {**git, "infoExcludeBase64": "YQ=" }, 1, "base64"),
        ([one()], {**git, "gitignoreSources": [{"path": "x/y", "contentsBase64": ""}]}, 1, "irrelevant-source"),
        ([one()], {"kind": "other"}, 1, "scope"),
    ]
    for entries, scope, refused, why in cases:
        for fmt in (1, 2):
            data = formats.inline(sorted(entries, key=lambda e: e["path"].encode()), scope, fmt) if scope["kind"] in ("git", "all-managed") else formats.document({"format": f"snapweave-tree-v{fmt}", "entries": entries, "scope": scope})
            outcome, reason = formats.upgrade(data)[:2]
            assert (outcome, reason) == (("upgraded", None) if refused == 4 else ("corrupt" if refused <= fmt else "format-incompatible", why)), (why, fmt)
    assert formats.upgrade(b"{}\n")[0] == "unrecognised" and formats.upgrade(b"x")[0] == "corrupt" and formats.upgrade(formats.inline([], formats.ALL_MANAGED, 1) + b"\n")[1] == "not-canonical"


def test_nodes_of_long_keys():
    """A key of the maximum is a node alone; above the leaves, nodes of one child take the next one's, the last joins the one before."""
    for count, above in ((2, [2]), (3, [3]), (4, [2, 2]), (5, [2, 3])):
        builder = formats.Builder(formats.entry_node)
        for c in "abcde"[:count]:
            builder.add((c * 40_000, file_entry(c, oid(c))))
        builder.finish()
        assert [x[2] for x in builder.out if x[0] == 0] == [1] * count and [x[2] for x in builder.out if x[0] == 1] == above
    assert formats.Builder(formats.entry_node).finish() is None


def record(content, kind="content", encoding="raw", name=None, length=None):
    return packfile.Record(kind, name or hashlib.sha256(content).hexdigest(), encoding, len(content) if length is None else length, content)


def test_record_bytes():
    r = record(b"abc")
    data = packfile.encode_record(r)
    assert data == b"CYRC\x01\x01\x00\x00" + hashlib.sha256(b"abc").digest() + b"\x03\x03abc" and packfile.decode_record(data) == r
    for broken in (data[:-1], data + b"\0", b"X" + data[1:], data[:4] + b"\2" + data[5:], data[:5] + b"\x09" + data[6:], data[:6] + b"\x03" + data[7:-5] + b"\x83\0" + data[-4:]):
        with pytest.raises(ValueError):
            packfile.decode_record(broken)
    for bad in (record(b"a", "scope", "delta1"), record(b"a", length=2), record(b"a", "recipe", "chunked-v1")):
        with pytest.raises(ValueError):
            packfile.encode_record(bad)


def test_pack_files(spark, tmp_path):
    records = [record(lcg(50 * i, i)) for i in range(5)]
    name, data = packfile.encode(records)
    assert data.startswith(b"CYPACK01\x01\x01\x00\x05") and data.endswith(b"CYPTRL01") and data[-40:-8].hex() == name == hashlib.sha256(data[:-40]).hexdigest()
    assert packfile.decode(data) == (name, "data", records)
    own, kind, entries = packfile.footer(data)
    assert (own, kind) == (name, "data") and entries == sorted(entries) and packfile.packed_length(records) == len(data)
    assert [e.ordinal for e in sorted(entries, key=lambda e: e.offset)] == list(range(5)) and min(e.offset for e in entries) == 12
    for broken in (data[:-1], data[:20] + b"x" + data[21:], b"", data + b"x", data[:-41] + b"x" + data[-40:]):
        with pytest.raises((ValueError, IndexError)):
            packfile.decode(broken)
    for wrong in (records + records[:1], [], [records[0], record(b"s", "scope")], [record(b"x")._replace(decoded_length=2)]):
        with pytest.raises(ValueError):
            packfile.encode(wrong)
    df = spark.createDataFrame([(1, *r) for r in records], f"batch int, {packfile.RECORD}")
    bodies = sum(len(packfile.encode_record(r)) for r in records)
    bound = spark.range(1).select(compaction.pack_bytes_bound(F.lit(5).cast("long"), F.lit(bodies).cast("long"))).first()[0]
    assert len(data) <= bound <= 2 * len(data) + 2000
    made = packfile.pack(df).first()
    assert packfile.decode(bytes(made.data))[2] == sorted(records, key=lambda r: r.logical_id) and made["class"] == "data"
    (tmp_path / "x.pack").write_bytes(data)
    assert rows(packfile.read(spark, str(tmp_path)).select("logical_id", F.length("payload"))) == sorted((r.logical_id, len(r.payload)) for r in records)


def test_multi_pack_index():
    packs = []
    for k in range(4):
        records = [record(lcg(20 + i, 10 * k + i), "content" if k % 2 else "scope") for i in range(k + 1)] + ([record(b"shared")] if k % 2 else [])
        name, data = packfile.encode(records)
        packs.append((name, packfile.class_of(records[0].kind), len(data), packfile.footer(data)[2]))
    data = packfile.encode_index(packs)
    assert data == packfile.encode_index(packs[::-1]) and data.startswith(b"CYMIDX01\x01\x00\x04\x0c") and data.endswith(b"CYMTRL01")
    listed, entries = packfile.decode_index(data)
    assert listed == sorted(p[:3] for p in packs) and entries == sorted(entries)
    fan = packfile.fan_out(e.logical_id for e in entries)
    for e in entries:
        found = packfile.look_up(entries, fan, e.logical_id, packfile.KIND_NAMES[e.kind])
        assert found == [x for x in entries if x[:2] == e[:2]]
    shared = hashlib.sha256(b"shared").hexdigest()
    assert len(packfile.look_up(entries, fan, shared, "content")) == 2 and packfile.look_up(entries, fan, shared, "scope") == [] and packfile.look_up(entries, fan, oid("no"), "content") == []
    for broken in (data[:-1], data[:30] + b"x" + data[31:], b""):
        with pytest.raises(ValueError):
            packfile.decode_index(broken)
    with pytest.raises(ValueError):
        packfile.encode_index(packs + packs[:1])


def test_scan(spark, tmp_path):
    import os

    for name, text in (("a/b.txt", "one"), ("a/B.TXT", "two"), ("big.bin", "x" * 100), ("a b+é.txt", "three"), (".git/config", "no"), (".gitignore", "*.log"), ("empty", ""), ("D/x", "1"), ("d/x", "2"), ("out/deep/f", "no")):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "link").symlink_to("a/b.txt")
    (tmp_path / "loop").symlink_to(".")
    (tmp_path / "h1").write_text("h")
    os.link(tmp_path / "h1", tmp_path / "h2")
    os.mkfifo(tmp_path / "pipe")
    open(os.fsencode(tmp_path) + b"/bad\xff", "w").close()
    outside = lambda p: p.select("path", (F.col("path") != "out").alias("managed"))
    good, bad, left_out = scan.scan(spark, str(tmp_path), max_bytes=50, managed=outside)
    files = {"a/B.TXT": "two", "a b+é.txt": "three", ".gitignore": "*.log", "empty": "", "D/x": "1"}
    assert rows(good.filter("kind = 'regular'").select("path", "oid")) == sorted([(p, oid(t)) for p, t in files.items()], key=repr)
    assert rows(good.filter("kind = 'symlink'").select("path", "target")) == [("link", "a/b.txt"), ("loop", ".")]
    assert dict(rows(bad)) == {"a/b.txt": "portable-collision", "d": "portable-collision", "big.bin": "too-large", "h1": "hardlink", "h2": "hardlink", "pipe": "unsupported", "bad\ufffd": "invalid-name"}
    assert rows(left_out) == [("out", "directory")]
    assert [x.count() for x in scan.scan(spark, f"file://{tmp_path}")] == [9, 6, 0]
    bad = bad.filter("path in ('a/b.txt', 'big.bin')")
    told = scan.summarize(bad, 1).first()
    assert (told.problems, told.more, [x.path for x in told.examples]) == (2, 1, ["a/b.txt"])
    log = tmp_path / "log.jsonl"
    log.write_text('{"type":"message","id":"1","parentId":null,"message":{"role":"user"}}\n{"type":"label","id":"2","parentId":"1"}\n')
    assert [(r.entry_id, r.parent_id, r.role, r.ord) for r in scan.session_log(spark, str(log)).orderBy("ord").collect()] == [("1", None, "user", 0), ("2", "1", None, 1)]


def test_stream_equals_batch(spark, tmp_path):
    schema = "session_id long, entry_id long, parent_id long, ord long"
    logs = [(s, 10 * s + k, None, k) for s in range(3) for k in range(4)]
    parts = [[r for r in logs if r[3] < 2], [r for r in logs if r[3] >= 2] + [(0, 99, None, 1)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    seen = {}

    def keep(batch, number):
        seen.update({r.session_id: tuple(r) for r in batch.collect()})

    query = observer.observe_stream(stream).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(keep).start()
    query.processAllAvailable()
    query.stop()
    want = {r.session_id: tuple(r) for r in observer.observe_batch(spark.createDataFrame(logs, schema)).collect()}
    assert seen[1] == want[1] and seen[2] == want[2]
    assert seen[0] == (0, 4, 3, 3, 1)  # the entry that came late is counted, not merged


def test_planners(spark, tmp_path):
    import subprocess

    from snapweave.operators import planning
    from snapweave.sources import ignore

    df = spark.createDataFrame([("d", k, n) for k, n in (("a", 4), ("b", 5), ("c", 2), ("e", 30), ("f", 1))], "class string, key string, length long")
    assert [r.batch for r in planning.batches(df, 10).orderBy("key").collect()] == [0, 0, 1, 2, 3]
    base = lcg(16 << 10)
    edits = [base[:4000] + b"12345678" + base[4008:], base[:12000] + b"abcdefgh" + base[12008:]]
    ranked = [("src/value.ts", c, k, n, bytes(b)) for c, k, n, b in (("base", 1, 5, base), ("first", 2, 1, edits[0]), ("second", 3, 1, edits[1]), ("other", 4, 1, lcg(16 << 10, 5)))]
    for order in (ranked, ranked[::-1]):
        got = planning.anchors(spark.createDataFrame(order, "path string, content_id string, rank long, n long, content binary"))
        assert {r.content_id for r in got.collect()} == {"base", "other"}
    coordinate = "session_id long, entry_id long, stable_parent_id long, ord long"
    source = spark.createDataFrame([(1, 10, None, 0), (1, 11, 10, 1), (1, 12, 11, 2), (1, 13, 10, 3)], coordinate)
    fork = spark.createDataFrame([(2, 1, 10, None, 0), (2, 1, 13, 10, 1), (2, 1, 12, 11, 2), (2, 1, 14, 13, 3)], "session_id long, source_session long, entry_id long, stable_parent_id long, ord long")
    assert rows(planning.proven(source, fork)) == [(2, 10), (2, 13)]
    one = spark.createDataFrame([("a", 1), ("b", 2)], "id string, offset long")
    assert planning.index_differences(one, one).count() == 0 and planning.index_differences(one, one.limit(1)).count() == 1
    packs = spark.createDataFrame([("p", 0, "x", None), ("p", 1, "y", 1), ("q", 0, "z", 3)], "pack_id string, ordinal long, logical_id string, back long")
    assert rows(planning.delta_chain(packs)) == [("p", "y", "x"), ("q", "z", None)]
    have = spark.createDataFrame([(".gitignore", "1"), ("a/.GitIgnore", "2"), ("b/.gitignore", "3"), ("x", "9")], "path string, oid string")
    kept = spark.createDataFrame([(".gitignore", "1"), ("a/.gitignore", "7"), ("c/.gitignore", "5")], "path string, oid string")
    assert rows(planning.scope_bindings(have, kept)) == [("not-archived", "b/.gitignore"), ("not-managed", "c/.gitignore"), ("other-content", "a/.GitIgnore")]
    assert planning.at_most(one, 2).count() == 2
    with pytest.raises(Exception, match="more than 1 rows"):
        planning.at_most(one, 1).collect()
    risk = spark.createDataFrame([(None,), ("2.1",), ("2.2",)], "v string").select(planning.replay_risk(F.col("v"), F.lit("2.2")))
    assert [r[0] for r in risk.collect()] == ["legacy-unattested", "version-mismatch", "none"]
    layer = lambda *x: spark.createDataFrame(list(x), "name string, value string")
    assert rows(planning.overlay(layer(("a", "1"), ("b", "2")), layer(("a", "3"), ("z", "4")), layer(("b", None)))) == [("a", "3"), ("b", "2")]
    edges = spark.createDataFrame([("r", 0, "n", "node"), ("r", 1, "c3", "chunk"), ("n", 0, "c1", "chunk"), ("n", 1, "c2", "chunk"), ("loop", 0, "loop", "node")], "parent_id string, ord long, child_id string, kind string")
    root = lambda n: spark.createDataFrame([("x", n)], "content_id string, node_id string")
    assert rows(planning.flatten_recipes(root("r"), edges)) == [("x", 0, "c1"), ("x", 1, "c2"), ("x", 2, "c3")]
    with pytest.raises(ValueError):
        planning.flatten_recipes(root("loop"), edges)
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / ".gitignore").write_text("*.log\n!keep.log\nbuild/\n")
    asked = spark.createDataFrame([("a.log",), ("keep.log",), ("build/x",), ("src/y",)], "path string")
    assert {r.path: r.managed for r in ignore.managed(asked, str(tmp_path)).collect()} == {"a.log": False, "keep.log": True, "build/x": False, "src/y": True}


def test_sessions(spark):
    from snapweave.operators import sessions

    schema = "session_id long, entry_id long, parent_id long, ord long, type string, role string"
    old = spark.createDataFrame([(1, 1, None, 0, "message", "user"), (1, 2, 1, 1, "label", None), (1, 3, 2, 2, "message", None)], schema)
    new = old.unionByName(spark.createDataFrame([(1, 4, 3, 3, "label", None), (1, 5, 4, 4, "message", None), (1, 6, 1, 5, "branch_summary", None), (1, 7, None, 6, "message", None)], schema))
    assert rows(sessions.landings(new)) == [(1, 1, 1), (1, 2, 1), (1, 3, 3), (1, 4, 3), (1, 5, 5), (1, 6, 6), (1, 7, 7)]
    claims = spark.createDataFrame([(1, 3, 5), (1, 1, 5), (1, 1, 6), (1, 2, 5), (1, 1, 3), (1, None, 7), (1, None, 5), (1, 3, 4)], "session_id long, ancestor_id long, descendant_id long")
    assert {(r[1], r[2]) for r in rows(sessions.natural_descent(old, new, claims)) if r[3]} == {(3, 5), (1, 6), (None, 7)}
    lost = new.filter("entry_id <> 3")
    assert not [r for r in rows(sessions.natural_descent(old, lost, claims)) if r[3]]
    event = "session_id long, event_id long, old_leaf long, new_leaf long, leaf long, expected_old long, expected long, summary_id long, summary_parent long"
    came = [(1, 0, 5, 3, 3, 5, 3, None, None), (1, 1, 5, 4, 4, 5, 3, None, None), (1, 2, 5, 3, 3, 9, 3, None, None), (1, 3, 5, 6, 6, 5, 1, 6, 1), (1, 4, 5, 6, 6, 5, 3, 6, 1), (1, 5, 5, 3, 3, 5, 1, 3, 2), (1, 6, 5, None, None, 5, None, None, None), (1, 7, 5, 99, 99, 5, None, None, None)]
    got = {r.event_id: (r.kind, r.landing_id) for r in sessions.arrivals(spark.createDataFrame(came, event), new).collect()}
    no = ("rejected", None)
    assert got == {0: ("direct", 3), 1: ("direct", 3), 2: no, 3: ("summary", 6), 4: no, 5: no, 6: ("direct", None), 7: no}
    at = "session_id long, pos long, entry_id long, stable_parent_id long, type string, role string"
    short = spark.createDataFrame([(1, 0, 1, None, "message", "user"), (2, 0, 1, None, "message", None), (3, 0, 1, None, "x", None)], at)
    long_ = spark.createDataFrame([(1, 0, 1, None, "message", "user"), (1, 1, 2, 1, "message", None), (2, 0, 1, 4, "message", None)], at)
    assert rows(sessions.coordinates_extend(short, long_)) == [(1, True), (2, False), (3, False)]


@pytest.mark.parametrize("change, want", [
    ({}, ("inherit", None)), ({"registered": True}, ("present", None)), ({"claim": "independent"}, ("fresh", None)), ({"claim": "indeterminate"}, ("retry", None)),
    ({"claim": "rejected", "reason": "source-store-missing"}, ("quarantine", "source-store-missing")), ({"identity": "conflict"}, ("quarantine", "source-registration-conflict")),
    ({"verified": False}, ("quarantine", "source-registration-unverified")), ({"again": "parent-graph-rewritten"}, ("quarantine", "parent-graph-rewritten")),
    ({"unchanged": False}, ("quarantine", "parent-claim-changed")), ({"exact": False}, ("quarantine", "source-projection-invalid")), ({"identity": "absent"}, ("quarantine", "source-registration-absent")),
    ({"local": False}, ("import", None)), ({"local": False, "self": True}, ("quarantine", "source-registration-conflict")), ({"local": False, "isolated": False}, ("quarantine", "unsafe-source-topology")),
])
def test_registration(spark, change, want):
    from snapweave.operators import sessions

    claim = {"session_id": 1, "registered": False, "claim": "observed", "reason": None, "local": True, "identity": "exact", "verified": True, "again": None, "unchanged": True, "exact": True, "self": False, "isolated": True}
    schema = "session_id long, registered boolean, claim string, reason string, local boolean, identity string, verified boolean, again string, unchanged boolean, exact boolean, self boolean, isolated boolean"
    got = sessions.registration(spark.createDataFrame([tuple((claim | change).values())], schema)).first()
    assert (got.disposition, got.reason) == want and (got.reason is None or got.reason in sessions.REASONS)


def test_materialize(spark):
    from snapweave.operators import sessions

    table = spark.createDataFrame([(1, 1, oid("a"), "open"), (1, 2, None, "blocked")], "session_id long, entry_id long, tree_oid string, capture_state string")
    asked = spark.createDataFrame([(1, k, how, oid("n")) for k in (1, 2, 3) for how in ("initialise-fresh", "adopt-protected")], "session_id long, entry_id long, intent string, oid string")
    got = {(r.entry_id, r.op): r.outcome for r in sessions.materialize(asked, table).collect()}
    assert got == {(1, "capture"): "slot-changed", (2, "capture"): "capture-blocked", (3, "capture"): "applied", (1, "adopt"): "not-blocked-missing", (2, "adopt"): "applied", (3, "adopt"): "not-blocked-missing"}
    times = spark.createDataFrame([(100, 40, 60), (100, 41, 60), (100, None, 60), (100, 0, 0)], "now long, last long, every long")
    assert [r[0] for r in times.select(sessions.due(F.col("now"), F.col("last"), F.col("every"))).collect()] == [True, False, True, False]


def test_compaction(spark):
    df = spark.createDataFrame
    tried = df([("t", "b", 5), ("t", "a", 5), ("t", "c", 9), ("u", "a", None)], "target_id string, base_id string, payload_bytes long")
    assert rows(compaction.best_bases(tried)) == [("t", "a", 5)]
    packs = df([("d", "p", 900), ("d", "q", 500), ("d", "r", 500)], "class string, pack_id string, size long")
    assert rows(compaction.opportunistic_source(packs, df([("d", 1000)], "class string, target long"))) == [("d", "q")]
    keys = df([("a",), ("b",), ("c",), ("x",)], "key string")
    size = compaction.decoded_lengths(keys, df([("a", 4), ("b", 3), ("a", 6), ("z", 9)], "key string, decoded_length long"), df([("c", 20), ("b", 2)], "key string, decoded_length long"))
    assert rows(size) == [("a", 6), ("b", 3), ("c", 20), ("x", None)]
    needs = df([("p", "a"), ("p", "b"), ("q", "b"), ("q", "c"), ("r", "x")], "pack_id string, key string")
    kept, whole = compaction.bound_decoded(needs, size, 10)
    assert rows(kept) == [("a",), ("b",)] and rows(whole) == [("p",)]
    added = df([("p", "a"), ("p", "b"), ("q", "c")], "pack_id string, key string")
    deltas = df([("a", "t", 300), ("b", "t", 200), ("c", "a", 900), ("a", "b", 900), ("s", "c", 10), ("w", "c", -5)], "base_key string, target_key string, saved long")
    judged = compaction.rewrite_savings(df([("p", 800), ("q", 50), ("n", 1)], "pack_id string, size long"), added, deltas.filter("base_key <> 'b'"))
    assert rows(judged) == [("n", 0, False), ("p", 300, True), ("q", 10, False)]
    left, stay = compaction.prune(df([("a",), ("b",), ("c",), ("k",)], "key string"), df([("p", "a"), ("q", "c"), ("z", "k")], "pack_id string, key string"), added, judged)
    assert rows(left) == [("a",), ("b",), ("k",)] and rows(stay) == [("p",), ("z",)]
    group = df([("p", "a", 4), ("q", "a", 4), ("q", "b", 5)], "pack_id string, key string, decoded_length long")
    one = df([("b",)], "key string")
    assert rows(compaction.extend_with_tier(one, group, 6, 10)) == [("a",), ("b",)]
    assert rows(compaction.extend_with_tier(one, group, 7, 10)) == [("b",)] == rows(compaction.extend_with_tier(one, group, 0, 10, most=1))[0:1]
    with pytest.raises(Exception, match="differ"):
        compaction.extend_with_tier(one, group.withColumn("decoded_length", F.expr("decoded_length + cast(pack_id = 'q' as long)")), 0, 100).collect()
    records = df([("d", k, 4) for k in "abcdef"], "class string, key string, length long")
    bases = df([("f", "a")], "target_id string, base_id string")
    for order in (records, records.orderBy(F.desc("key"))):
        placed, facts = compaction.plan(order, bases, 8)
        batch = {r.key: r.batch for r in placed.collect()}
        assert batch["a"] == batch["f"] and len(set(batch.values())) == 3 and rows(facts) == [(batch["a"], "f", "a")]
        assert rows(compaction.plan_metrics(placed, records)) == [("d", 3, 6, 24)]
    root = df([("x",), ("y",)], "tree_oid string")
    assert compaction.root_drift(root, root, root).isEmpty() and rows(compaction.root_drift(root, root.limit(1), root)) == [("y", 2)]
    assert rows(compaction.large_legacy(df([("s", 65536), ("l", 65537)], "content_id string, byte_length long"))) == [("l", 8)]


def test_cycle(spark):
    df = spark.createDataFrame
    entries = df([("p", "content", "a", 10, 10), ("p", "content", "b", 30, 30), ("q", "content", "c", 5, 5), ("r", "content", "d", 5, 5)], "pack_id string, kind string, logical_id string, length long, decoded_length long")
    objects = df([("a", False, 1), ("b", False, 1), ("c", False, 1), ("n", False, 9), ("t", True, 1)], "object_id string, temporary boolean, modified long")
    edges = df([("x", "a"), ("x", "c"), ("y", "b")], "tree_oid string, logical_id string")
    reach = lambda roots: edges.join(roots, "tree_oid", "left_semi").select(F.lit("content").alias("kind"), "logical_id")
    wrote = []
    run = lambda reads: compaction.cycle(entries, objects, reads, reach, lambda placed, _: wrote.append(rows(placed)), F.lit(5)).first()
    told = run(lambda: df([("x",)], "tree_oid string"))
    assert wrote[-1] == [("content", "content:a", 0)] and told.held_still and told.rewritten_packs == 1
    assert (told.dead_packs, told.partial_packs, told.live_packs, told.freed_bytes) == (1, 1, 1, 35)
    assert (told.temporary_objects, told.dead_objects, told.superseded_objects) == (1, 1, 1)
    now = iter([["x"], ["x", "y"], ["x"]])
    moved = run(lambda: df([(r,) for r in next(now)], "tree_oid string"))
    assert not moved.held_still and moved.dead_objects == 0


def test_stored_trees(spark):
    from snapweave.operators import trees

    df = spark.createDataFrame
    files = [file_entry("a/b", oid("1")), file_entry("c", oid("2"))]
    docs = {
        "one": formats.inline(files, formats.ALL_MANAGED, 1), "two": formats.inline(files, formats.ALL_MANAGED, 2), "deep": formats.inline([file_entry("/".join("a" * 300), oid("1"))], formats.ALL_MANAGED, 1),
        "none": formats.inline([], formats.ALL_MANAGED, 2), "later": formats.document({"format": "snapweave-tree-v9"}), "half": formats.document({"format": "snapweave-tree-v2"}), "noise": b"{",
    }
    docs["now"] = formats.build(files, formats.ALL_MANAGED)[1][formats.build(files, formats.ALL_MANAGED)[0]]
    stored = df([(oid_of_bytes(d), d) for d in docs.values()] + [(oid("other"), docs["one"])], "oid string, document binary")
    names = {oid_of_bytes(d): n for n, d in docs.items()} | {oid("other"): "corrupt"}
    read = trees.read_stored(stored)
    assert {names[r.oid]: (r.state, r.entries) for r in read.collect()} == {"one": ("intact", 2), "two": ("intact", 2), "deep": ("intact", 1), "none": ("intact", 0), "now": ("intact", 0), "later": ("unrecognised", None), "half": ("corrupt", None), "noise": ("corrupt", None), "corrupt": ("corrupt", None)}
    upgraded = trees.upgrade(stored).cache()
    got = {names[r.old_oid]: r for r in upgraded.collect()}
    assert {n: r.outcome for n, r in got.items()} == {"one": "upgraded", "two": "upgraded", "deep": "format-incompatible", "none": "upgraded", "now": "current", "later": "unrecognised", "half": "corrupt", "noise": "corrupt", "corrupt": "corrupt"}
    assert got["one"].new_oid == got["two"].new_oid == got["now"].new_oid == got["now"].old_oid != got["none"].new_oid and got["deep"].reason == "path-limit"
    roots = df([(oid_of_bytes(docs["one"]),), (oid_of_bytes(docs["now"]),)], "tree_oid string")
    assert trees.upgrade_map(roots, upgraded).count() == 2
    with pytest.raises(Exception, match="no upgrade"):
        trees.upgrade_map(roots.unionByName(df([(oid_of_bytes(docs["deep"]),)], "tree_oid string")), upgraded).collect()


def test_maps_are_read_whole(spark):
    from snapweave.operators import trees

    files = [(f"src/file-{i:05d}.ts", oid(str(i))) for i in range(2000)]
    entries = spark.createDataFrame([("t", p, "regular", o, 420, None, None) for p, o in files] + [("t", "z", "symlink", None, None, "é", "file"), ("one", "x", "regular", oid("x"), None, None, None)], "tree string, path string, type string, blob_oid string, mode int, target string, symlink_kind string")
    stored = formats.stored_columns(entries)
    nodes = formats.map_nodes(stored).cache()
    scopes = spark.createDataFrame([(t, formats.scope_objects(formats.ALL_MANAGED)[0]) for t in ("t", "one", "empty")], "tree string, scope_oid string")
    made = {r.tree: r.root_oid for r in trees.tree_roots(nodes, scopes).collect()}
    link = {"path": "z", "type": "symlink", "target": "é", "symlinkKind": "file"}
    assert made["t"] == formats.build([*(file_entry(p, o, 420) for p, o in files), link], formats.ALL_MANAGED)[0] and made["empty"] == formats.build([], formats.ALL_MANAGED)[0]
    root = trees.map_roots(nodes).filter("tree = 't'")
    got, bad = trees.read_map(nodes, root)
    assert rows(got) == rows(stored.filter("tree = 't'")) and bad.isEmpty() and nodes.agg(F.max("level")).first()[0] > 0
    leaf = nodes.filter("tree = 't' and level = 0").orderBy("oid").first()
    lost, bad = trees.read_map(nodes.filter(F.col("oid") != leaf.oid), root)
    assert lost.count() == 2001 - leaf.children and {r.rule for r in bad.collect()} == {"missing-node", "not-rebuilt"}
    changed = nodes.withColumn("document", F.when(F.col("oid") == leaf.oid, F.encode(F.lit("{}\n"), "utf-8")).otherwise(F.col("document")))
    assert {r.rule for r in trees.read_map(changed, root)[1].collect()} == {"corrupt", "not-rebuilt"}
    new = trees.publish_tree(nodes, nodes.filter("level = 0").select("oid").limit(1))
    assert new.count() == nodes.select("oid").distinct().count() - 1


def test_scopes_and_spelling(spark):
    import base64

    from snapweave.operators import trees

    df = spark.createDataFrame
    one = lambda column, *values: [r[0] for r in df([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]
    good = base64.b64encode(b"*.log\n" * 20).decode()
    assert one(trees.canonical_base64, good, "YQ==", "YQ", "YR==", "?", "", None) == [b"*.log\n" * 20, b"a", None, None, None, b"", None]
    assert one(trees.canonical_json, '{ "b": 1,  "a": ["é"] }', None) == ['{"b":1,"a":["é"]}\n', None]
    assert one(trees.display_path, "a/b.txt", "a b", " a", "", 'q"x', "a\\b", "a\x1bb", "naïve", None) == ["a/b.txt", "a b", '" a"', '""', '"q\\"x"', '"a\\\\b"', '"a\\u{1b}b"', "naïve", None]
    near = [(".gitignore", "src"), ("src/.gitignore", "src"), ("src/a/.gitignore", "src"), ("lib/.gitignore", "src"), ("lib/.gitignore", ""), ("src/x", "src"), ("sr/.gitignore", "src")]
    assert [r[0] for r in df(near, "p string, q string").select(trees.source_is_relevant(F.col("p"), F.col("q"))).collect()] == [True, True, True, False, True, False, False]
    sources = df([("s", ".gitignore", good), ("s", "a/.gitignore", "YQ"), ("s", "A/.gitignore", "YQ=="), ("s", "x", "YQ=="), ("t", ".gitignore", good)], "scope string, path string, contents string")
    assert rows(trees.scope_problems(sources, most=3)) == [("duplicate", "s", "a/.gitignore"), ("not-a-source", "s", "x"), ("not-canonical", "s", "a/.gitignore"), ("over-budget", "s", None)]
    have = df([("a", True), ("b", False), (".GITIGNORE", True)], "path string, managed boolean")
    kept = df([(".gitignore", True), ("c/.gitignore", True), ("d/.gitignore", False)], "path string, managed boolean")
    assert rows(trees.scope_agreement(have, kept)) == [("excluded-entry", "b"), ("missing-source", "c/.gitignore")]


def test_migration(spark):
    from snapweave.operators import trees

    state = {"version": 1, "roots": ["a"], "reads": 0}

    def roots():
        state["reads"] += 1
        return spark.createDataFrame([(r,) for r in state["roots"] + (["b"] if state["reads"] == 1 else [])], "tree_oid string")

    def apply(version):
        return lambda prepared: state.update(version=version, last=prepared)

    steps = {1: (lambda r: sorted(x[0] for x in r.collect()), apply(2)), 2: (lambda r: r.count(), apply(3))}
    assert trees.migrate(lambda: state["version"], roots, steps, 3) == 2 and (state["version"], state["last"]) == (3, 1)
    assert state["reads"] == 6  # the first try of the first step saw the roots change
    stuck = {"n": 0}

    def moving():
        stuck["n"] += 1
        return spark.createDataFrame([(str(stuck["n"]),)], "tree_oid string")

    with pytest.raises(RuntimeError, match="hold still"):
        trees.migrate(lambda: 1, moving, steps, 2, tries=2)


def test_records(spark):
    from snapweave.sources import objects

    df = spark.createDataFrame
    base, noise = b"all work and no play\n" * 500, lcg(5000)
    target = noise[:2000] + b"changed" + noise[2007:]
    made = objects.encode(df([("content", base), ("content", noise), ("content", target), ("scope", b""), ("content", None)], "kind string, content binary"))
    told = {r.logical_id: (r.encoding, r.decoded_length) for r in made.collect()}
    name = lambda b: hashlib.sha256(b).hexdigest()
    assert told == {name(base): ("zstd-v1", len(base)), name(noise): ("raw", 5000), name(target): ("raw", 5000), name(b""): ("raw", 0)}
    with pytest.raises(Exception, match="must be chunked"):
        objects.encode(df([("content", b"x" * (objects.WHOLE + 1))], "kind string, content binary")).collect()
    delta = objects.delta_records(df([(name(target), name(noise), target, noise), (name(base), name(noise), base, noise)], "target_id string, base_id string, target binary, base binary"), made)
    assert [(r.logical_id, r.encoding) for r in delta.collect()] == [(name(target), "delta1")]
    steps = [("copy", 3, 300), ("add", b"xyz"), ("copy", 0, 1)]
    assert objects.read_delta(objects.write_delta(2, steps)) == (2, steps)
    assert objects.write_delta(2, [("copy", 1, 3), ("add", b"!")]) == b"\1\2\2\0\1\3\1\1!"
    for broken in (objects.write_delta(2, steps) + b"\0", objects.write_delta(2, steps)[:-1], b"\1\2\1\7", b""):
        with pytest.raises(ValueError):
            objects.read_delta(broken)
    root = oid("root")
    long_ = noise + base
    edges = df([(root, 0, name(noise), "chunk"), (root, 1, name(base), "chunk")], "parent_id string, ord long, child_id string, kind string")
    chunked = df([("content", name(long_), "chunked-v1", len(long_), bytes.fromhex(root))], objects.RECORD)
    bad = df([("content", oid("?"), "raw", 3, b"abc"), ("content", name(b"abcd"), "raw", 3, b"abcd"), ("content", name(b"z" * 99), "zstd-v1", 99, b"junk")], objects.RECORD)
    full = made.filter(F.col("logical_id") != name(target))
    got = {r.logical_id: r.content and bytes(r.content) for r in objects.decode(full.unionByName(chunked).unionByName(bad).unionByName(delta, allowMissingColumns=True), edges).collect()}
    assert got == {name(base): base, name(noise): noise, name(target): target, name(long_): long_, name(b""): b"", oid("?"): None, name(b"abcd"): None, name(b"z" * 99): None}
    pairs = [(k, e) for k in ("content", "scope", "other") for e in ("raw", "delta1", "chunked-v1", "lzma")]
    fits = df(pairs, "k string, e string").filter(objects.compatible(F.col("k"), F.col("e")))
    assert rows(fits) == [("content", "chunked-v1"), ("content", "delta1"), ("content", "raw"), ("scope", "raw")]
    have = "kind string, logical_id string, content binary"
    asked = df([("content", name(b"a")), ("content", name(b"b")), ("scope", name(b"c"))], "kind string, logical_id string")
    first, second = df([("content", name(b"a"), b"a"), ("content", name(b"b"), b"spoilt")], have), df([("content", name(b"a"), b"a"), ("content", name(b"b"), b"b")], have)
    assert {r.logical_id: r.source for r in objects.resolve(asked, first, second).collect()} == {name(b"a"): 0, name(b"b"): 1, name(b"c"): None}


def test_store_folders(spark, tmp_path):
    from snapweave.sources import objects

    home = f"file://{tmp_path}/packs"
    contents = [lcg(40 * k + 1, k) for k in range(7)]
    ids = [hashlib.sha256(c).hexdigest() for c in contents]
    records = [(k // 3, *record(c)) for k, c in enumerate(contents)]
    packs = packfile.pack(spark.createDataFrame(records, f"batch int, {packfile.RECORD}")).cache()
    assert [s for _, s in objects.publish_packs(packs, home)] == ["published"] * 3
    assert [s for _, s in objects.publish_packs(packs, home)] == ["existing"] * 3
    listed = objects.pack_inventory(spark, home)
    read = objects.read_records(spark, home, listed)
    assert {r.logical_id: bytes(r.payload) for r in read.collect()} == dict(zip(ids, contents, strict=True))
    sizes = packs.select("pack_id", F.octet_length("data").cast("long").alias("bytes"))
    objects.write_index(listed, sizes, f"{home}/index")
    stored, differ = objects.read_index(spark, f"{home}/index", listed)
    assert differ.isEmpty() and rows(stored.select("logical_id")) == sorted((i,) for i in ids)
    assert objects.read_index(spark, f"{home}/index", listed.filter(F.col("logical_id") != ids[0]))[1].count() == 1
    target = contents[6][:100] + b"!" + contents[6][101:]
    steps = objects.write_delta(1, [("copy", 0, 100), ("add", b"!"), ("copy", 101, len(target) - 101)])
    (tmp_path / "d").mkdir()
    pack_name, data = packfile.encode([record(contents[6]), packfile.Record("content", hashlib.sha256(target).hexdigest(), "delta1", len(target), steps)])
    (tmp_path / "d" / f"{pack_name}.pack").write_bytes(data)
    both = objects.with_bases(objects.read_records(spark, f"file://{tmp_path}/d", objects.pack_inventory(spark, f"file://{tmp_path}/d")))
    none = spark.createDataFrame([], "parent_id string, ord long, child_id string, kind string")
    assert {r.logical_id: bytes(r.content) for r in objects.decode(both.drop("pack_id", "ordinal"), none).collect()} == {ids[6]: contents[6], hashlib.sha256(target).hexdigest(): target}
    moved = stored.withColumn("offset", F.expr(f"offset + cast(logical_id = '{ids[1]}' as long)"))
    found = {r.logical_id: (r.hinted, r.offset is not None) for r in objects.locate(spark.createDataFrame([(ids[0],), (ids[1],), (oid("no"),)], "logical_id string"), moved, listed).collect()}
    assert found == {ids[0]: (True, True), ids[1]: (False, True), oid("no"): (False, False)}
    store = tmp_path / "store"
    for space in objects.NAMESPACES:
        (store / space / "ab").mkdir(parents=True)
    name = "ab" + "0" * 62
    (store / "content/ab" / name[2:]).write_bytes(b"12345")
    (store / "recipe/ab" / (name[2:] + ".7.tmp")).write_bytes(b"1")
    (store / "legacy/ab/stray").write_bytes(b"")
    known, odd = objects.loose_inventory(spark, str(store))
    assert rows(known.select("namespace", "logical_id", "byte_length", "temporary")) == [("content", name, 5, False), ("recipe", name, 1, True)]
    assert [r.path.rsplit("/", 1)[1] for r in odd.collect()] == ["stray"]


def test_observer_counts_broken_parents(spark, tmp_path):
    schema = "session_id long, entry_id long, parent_id long, ord long"
    logs = [(1, 10, None, 0), (1, 11, 10, 1), (2, 20, None, 0), (2, 21, 99, 1), (3, 30, 31, 0), (3, 31, None, 1), (4, 40, None, 0), (4, 40, None, 1)]
    frame = spark.createDataFrame(logs, schema)
    assert {r.session_id: r.violations for r in observer.observe_batch(frame).collect()} == {1: 0, 2: 1, 3: 1, 4: 1}
    frame.coalesce(1).write.parquet(f"{tmp_path}/logs")
    got = {}
    stream = observer.observe_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/logs"))
    keep = lambda batch, _: got.update({r.session_id: r.violations for r in batch.collect()})
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination(100)
    # what follows an entry that was not merged is out of place too
    assert got == {1: 0, 2: 1, 3: 2, 4: 1}
