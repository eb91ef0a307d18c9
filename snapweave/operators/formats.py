"""Stored trees of three published formats: their documents byte for byte, the rules of each, and upgrades from one to the next.

Formats 1 and 2 are one JSON document with all entries and the scope inside. In format 3 the entries are a search tree of node
documents, named by their digests, in which a node's end depends on the keys alone; so do the sources of a scope. Documents name the
kind of thing that they are after the product that wrote them, so every function takes that name (``namespace``); ids agree with
those of another product's stores if its name is given.

An entry is a dict: path, type regular, blobOid, recreationMode; or path, type symlink, target, symlinkKind. A scope is a dict: kind
all-managed; or kind git, repositoryPrefix, evaluator, ignoreCase, gitignoreSources (path, contentsBase64), infoExcludeBase64 and
globalExcludeBase64.
"""

from __future__ import annotations

import base64
import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import MAX_BYTES, MAX_COMPONENTS, fold_key

NAMESPACE = "snapweave"
#: Fixed values of the formats: bytes of keys in a node, and what a key costs besides its own bytes.
NODE_MINIMUM, NODE_TARGET, NODE_MAXIMUM, KEY_OVERHEAD = 8 << 10, 16 << 10, 32 << 10, 192
#: Limits of a scope's archived sources, and of an evaluator's version.
MOST_SOURCES, SOURCE_BYTES, POLICY_BYTES, VERSION_BYTES = 100_000, 256 << 10, 16 << 20, 256
MOST_LEVELS = 64
OLD_GIT_KEYS = ("kind", "repositoryPrefix", "ignoreCase", "gitignoreSources", "infoExcludeBase64", "globalExcludeBase64")
GIT_KEYS = ("kind", "repositoryPrefix", "evaluator", "ignoreCase", "gitignoreSources", "infoExcludeBase64", "globalExcludeBase64")
ALL_MANAGED = {"kind": "all-managed"}


class Invalid(ValueError):
    """A document, entry or scope that its format does not allow."""


def document(value: object) -> bytes:
    """The canonical bytes of a JSON value: keys in their order, nothing escaped that need not be, a line feed at the end."""
    return (json.dumps(value, ensure_ascii=False, separators=(",", ":")) + "\n").encode()


def oid_of(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def need(ok: object, what: str) -> None:
    if not ok:
        raise Invalid(what)


def is_oid(x: object) -> bool:
    return isinstance(x, str) and len(x) == 64 and set(x) <= set("0123456789abcdef")


def path_of(x: object, fmt: int, root: bool = False) -> str:
    """x, if it is a path of the format; format 1 has no limits, and knows fewer spellings of the name that is forbidden."""
    need(isinstance(x, str) and (x or root), "path")
    try:
        size = len(x.encode())
    except UnicodeEncodeError:
        raise Invalid("path") from None
    need(not any(c in x for c in "\0\\") and x[:1] != "/" and unicodedata.normalize("NFC", x) == x, "path")
    if not x:
        return x
    parts = x.split("/")
    need(fmt == 1 or size <= MAX_BYTES and len(parts) <= MAX_COMPONENTS, "path-limit")
    same = str.lower if fmt == 1 else fold_key
    need(not any(c in ("", ".", "..") or same(c) == ".git" for c in parts), "path")
    return x


def bytes_of(x: object, fmt: int) -> bytes:
    """The bytes of a canonical base64 text. Formats 1 and 2 allowed a NUL byte."""
    need(isinstance(x, str), "base64")
    try:
        data = base64.b64decode(x, validate=True)
    except ValueError:
        raise Invalid("base64") from None
    need(base64.b64encode(data).decode() == x, "base64")
    need(len(data) <= SOURCE_BYTES, "source-limit")
    need(fmt < 3 or b"\0" not in data, "nul-byte")
    return data


def relevant(path: str, prefix: str) -> bool:
    """Whether an ignore source bears on what lies below prefix: its folder is that, or above it, or below it."""
    folder, _, name = path.rpartition("/")
    return name == ".gitignore" and (folder in ("", prefix) or not prefix or prefix.startswith(f"{folder}/") or folder.startswith(f"{prefix}/"))


def scope_of(x: object, fmt: int) -> dict:
    """The canonical scope, with an evaluator (None before format 3)."""
    need(isinstance(x, dict), "scope")
    if x.get("kind") == "all-managed":
        need(set(x) == {"kind"}, "scope")
        return dict(ALL_MANAGED)
    need(x.get("kind") == "git" and set(x) == set(GIT_KEYS if fmt == 3 else OLD_GIT_KEYS), "scope")
    need(isinstance(x["ignoreCase"], bool) and isinstance(x["gitignoreSources"], list), "scope")
    need(len(x["gitignoreSources"]) <= MOST_SOURCES, "source-limit")
    prefix, evaluator, total, sources = path_of(x["repositoryPrefix"], fmt, root=True), None, 0, []
    if fmt == 3 and x["evaluator"] is not None:
        e = x["evaluator"]
        need(isinstance(e, dict) and set(e) == {"version", "precomposeUnicode"} and isinstance(e["precomposeUnicode"], bool), "evaluator")
        v = e["version"]
        need(isinstance(v, str) and 0 < len(v) <= VERSION_BYTES and all(" " <= c <= "~" for c in v), "evaluator")
        evaluator = {"version": v, "precomposeUnicode": e["precomposeUnicode"]}
    for s in x["gitignoreSources"]:
        need(isinstance(s, dict) and set(s) == {"path", "contentsBase64"}, "scope")
        p = path_of(s["path"], fmt)
        need(relevant(p, prefix), "irrelevant-source")
        total += len(bytes_of(s["contentsBase64"], fmt))
        sources.append({"path": p, "contentsBase64": s["contentsBase64"]})
    sources.sort(key=lambda s: s["path"].encode())
    need(len({s["path"] for s in sources}) == len(sources), "duplicate-source")
    total += sum(len(bytes_of(x[k], fmt)) for k in GIT_KEYS[-2:])
    need(total <= POLICY_BYTES, "policy-limit")
    return {"kind": "git", "repositoryPrefix": prefix, "evaluator": evaluator, "ignoreCase": x["ignoreCase"], "gitignoreSources": sources, **{k: x[k] for k in GIT_KEYS[-2:]}}


def same_scope(a: object, b: object, fmt: int = 3) -> bool:
    return document(scope_of(a, fmt)) == document(scope_of(b, fmt))


def entry_of(x: object, fmt: int) -> dict:
    need(isinstance(x, dict), "entry")
    path, kind = path_of(x.get("path"), fmt), x.get("type")
    if kind == "regular":
        need(set(x) == {"path", "type", "blobOid", "recreationMode"} and is_oid(x["blobOid"]), "entry")
        mode = x["recreationMode"]
        need(mode is None or isinstance(mode, int) and not isinstance(mode, bool) and 0 <= mode <= 0o7777, "mode")
        return {"path": path, "type": kind, "blobOid": x["blobOid"], "recreationMode": mode}
    need(kind == "symlink" and set(x) == {"path", "type", "target", "symlinkKind"}, "entry")
    need(isinstance(x["target"], str) and x["target"] and "\0" not in x["target"] and x["symlinkKind"] in (None, "file", "directory"), "entry")
    try:
        x["target"].encode()
    except UnicodeEncodeError:
        raise Invalid("entry") from None
    return {"path": path, "type": kind, "target": x["target"], "symlinkKind": x["symlinkKind"]}


def entries_of(values: object, fmt: int) -> list[dict]:
    """The canonical entries: valid, in byte order, no path twice or in two spellings, none below another."""
    need(isinstance(values, list), "entries")
    out = sorted((entry_of(x, fmt) for x in values), key=lambda e: e["path"].encode())
    key, owner = str.lower if fmt == 1 else fold_key, {}
    paths = {e["path"] for e in out}
    need(len(paths) == len(out), "duplicate-path")
    for e in out:
        parts = e["path"].split("/")
        for k in range(len(parts), 0, -1):
            p = "/".join(parts[:k])
            need(k == len(parts) or p not in paths, "managed-parent")
            need(owner.setdefault(key(p), p) == p, "portable-alias")
    return out


def check_bindings(entries: list[dict], scope: dict, fmt: int) -> None:
    """Ignore files among the entries are those that a git scope has archived, byte for byte."""
    if scope["kind"] != "git":
        return
    git_key = str.lower if scope["ignoreCase"] else str
    key = git_key if fmt == 1 else fold_key
    local: dict[str, tuple[str, str]] = {}
    for s in scope["gitignoreSources"]:
        prefix = scope["repositoryPrefix"]
        p = s["path"] if not prefix else s["path"][len(prefix) + 1 :] if s["path"].startswith(f"{prefix}/") else None
        if p is not None:
            need(local.setdefault(key(p), (p, ""))[0] == p, "source-alias")
            local[key(p)] = (p, oid_of(bytes_of(s["contentsBase64"], fmt)))
    for e in entries:
        name = e["path"].rpartition("/")[2]
        held = local.get(key(e["path"]))
        if held is not None:
            need(e["type"] == "regular" and e["blobOid"] == held[1] and (fmt == 1 or e["path"] == held[0]), "source-mismatch")
        elif e["type"] == "regular" or fmt > 1:
            need((git_key(name) if fmt == 1 else fold_key(name)) != ".gitignore", "source-missing")


def manifest_of(entries: object, scope: object, fmt: int) -> tuple[list[dict], dict]:
    found, where = entries_of(entries, fmt), scope_of(scope, fmt)
    check_bindings(found, where, fmt)
    return found, where


def inline(entries: list[dict], scope: dict, fmt: int, namespace: str = NAMESPACE) -> bytes:
    """The document of a tree of format 1 or 2."""
    kept = scope if scope["kind"] != "git" else {k: scope[k] for k in OLD_GIT_KEYS}
    return document({"format": f"{namespace}-tree-v{fmt}", "entries": entries, "scope": kept})


class Level:
    """One level of a search tree that is built as a stream: its open node, and nodes that wait for the next one.

    A node ends where the next key would pass the maximum, or from the minimum on at a key whose hash says so. Above the leaves a node
    of one child takes the next node's children too; a last such one joins the node before.
    """

    def __init__(self, level: int, tag: bytes):
        self.level, self.tag = level, tag
        self.open: list[tuple] = []
        self.payload = 0
        self.single: list[tuple] = []
        self.held: list[tuple] = []

    def closes(self, key: bytes, weight: int) -> bool:
        return int.from_bytes(hashlib.sha256(self.tag + key).digest()[:4], "big") < (min(weight, NODE_TARGET) << 32) // NODE_TARGET

    def add(self, item: tuple) -> Iterator[list[tuple]]:
        """Take an item (key, ...) and give nodes that are complete."""
        key = item[0].encode()
        weight = len(key) + KEY_OVERHEAD
        if self.open and self.payload + weight > NODE_MAXIMUM:
            yield from self.close()
        self.open.append(item)
        self.payload += weight
        if self.payload >= NODE_MAXIMUM or self.payload >= NODE_MINIMUM and self.closes(key, weight):
            yield from self.close()

    def close(self) -> Iterator[list[tuple]]:
        group, self.open, self.payload = self.open, [], 0
        if self.level == 0:
            yield group
        elif self.single:
            yield from self.keep(self.single + group)
            self.single = []
        elif len(group) == 1:
            self.single = group
        else:
            yield from self.keep(group)

    def keep(self, group: list[tuple]) -> Iterator[list[tuple]]:
        """Hold a node until the next one is known, which may be a last single child."""
        if self.held:
            yield self.held
        self.held = group

    def end(self) -> Iterator[list[tuple]]:
        if self.open:
            yield from self.close()
        if self.held or self.single:
            yield self.held + self.single
            self.held = self.single = []


class Builder:
    """The nodes of one search tree from its items in order of key. A level holds its open node and the two before at most.

    made(level, items) gives a node's document; a node becomes an item (high key, oid, count) of the level above, unless it is alone.
    """

    def __init__(self, made: Callable[[int, list[tuple]], bytes], namespace: str = NAMESPACE):
        self.made, self.tag = made, f"{namespace}-prolly-key-boundary-v1\0".encode()
        self.levels: list[Level] = []
        self.counts: list[int] = []
        self.first: list[tuple | None] = []
        #: level, number in the level, children, entries below, high key, oid, document
        self.out: list[tuple[int, int, int, int, str, str, bytes]] = []

    def add(self, item: tuple, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append(Level(level, self.tag))
            self.counts.append(0)
            self.first.append(None)
        for group in self.levels[level].add(item):
            self.node(level, group)

    def node(self, level: int, group: list[tuple]) -> None:
        data = self.made(level, group)
        total = len(group) if level == 0 else sum(x[2] for x in group)
        item = (group[-1][0], oid_of(data), total)
        self.out.append((level, self.counts[level], len(group), total, *item[:2], data))
        self.counts[level] += 1
        if self.counts[level] == 1:
            self.first[level] = item
            return
        if self.counts[level] == 2:
            self.add(self.first[level], level + 1)
        self.add(item, level + 1)

    def finish(self) -> tuple[int, str] | None:
        """Level and oid of the root, if there is any item."""
        level = 0
        while level < len(self.levels):
            for group in self.levels[level].end():
                self.node(level, group)
            level += 1
        return (level - 1, self.first[level - 1][1]) if level else None


def entry_node(level: int, group: list[tuple], namespace: str = NAMESPACE) -> bytes:
    """A node of entries: items are (path, stored entry) at the leaves, (high key, oid, count) above."""
    head = {"kind": f"{namespace}-tree-node", "version": 1, "level": level}
    if level == 0:
        return document({**head, "entries": [x[1] for x in group]})
    return document({**head, "children": [{"highKey": k, "oid": o, "entryCount": n} for k, o, n in group]})


def source_node(level: int, group: list[tuple], namespace: str = NAMESPACE) -> bytes:
    head = {"kind": f"{namespace}-tree-scope-source-node", "version": 1, "level": level}
    if level == 0:
        return document({**head, "sources": [x[1] for x in group]})
    return document({**head, "children": [{"highKey": k, "oid": o, "sourceCount": n} for k, o, n in group]})


def stored_entry(e: dict) -> dict:
    """An entry as a leaf has it: the target of a symlink is a content of its own."""
    if e["type"] == "regular":
        return e
    data = e["target"].encode()
    return {"path": e["path"], "type": "symlink", "targetContentId": oid_of(data), "targetByteLength": len(data), "symlinkKind": e["symlinkKind"]}


def scope_objects(scope: dict, namespace: str = NAMESPACE) -> tuple[str, list[tuple[str, bytes]], list[bytes]]:
    """The oid of a canonical scope's document; its objects (oid, document), what they refer to first; and the contents that they name."""
    head = {"kind": f"{namespace}-tree-scope", "version": 1, "scopeKind": scope["kind"]}
    objects, contents = [], []
    if scope["kind"] == "git":

        def content(text: str) -> dict:
            data = bytes_of(text, 3)
            contents.append(data)
            return {"contentId": oid_of(data), "byteLength": len(data)}

        builder = Builder(lambda level, group: source_node(level, group, namespace), namespace)
        for s in scope["gitignoreSources"]:
            builder.add((s["path"], {"path": s["path"], **content(s["contentsBase64"])}))
        top = builder.finish()
        objects = [(x[5], x[6]) for x in builder.out]
        head |= {"repositoryPrefix": scope["repositoryPrefix"], "evaluator": scope["evaluator"], "ignoreCase": scope["ignoreCase"], "gitignoreSourceCount": len(scope["gitignoreSources"])}
        head |= {"gitignoreSourceRoot": top[1] if top else None, "infoExclude": content(scope["infoExcludeBase64"]), "globalExclude": content(scope["globalExcludeBase64"])}
    data = document(head)
    return oid_of(data), [*objects, (oid_of(data), data)], contents


def root_document(top: tuple[int, str] | None, n: int, scope_oid: str, namespace: str = NAMESPACE) -> bytes:
    return document(
        {
            "kind": f"{namespace}-tree-root", "version": 1, "format": f"{namespace}-tree-v3", "profile": f"{namespace}-prolly-key-v1",
            "height": top[0] if top else 0, "entryCount": n, "entryMapRoot": top[1] if top else None, "scopeOid": scope_oid,
        }
    )


def build(entries: Iterable[dict], scope: dict, namespace: str = NAMESPACE) -> tuple[str, dict[str, bytes], dict[str, bytes]]:
    """Root oid, objects (what they refer to first, the root last) and new contents of a tree of canonical entries and scope."""
    scope_oid, objects, contents = scope_objects(scope, namespace)
    builder, n, targets = Builder(lambda level, group: entry_node(level, group, namespace), namespace), 0, []
    for e in entries:
        builder.add((e["path"], stored_entry(e)))
        targets += [e["target"].encode()] if e["type"] == "symlink" else []
        n += 1
    root = root_document(builder.finish(), n, scope_oid, namespace)
    return oid_of(root), dict([*objects, *((x[5], x[6]) for x in builder.out), (oid_of(root), root)]), {oid_of(c): c for c in (*contents, *targets)}


def _walk(top: str | None, height: int, get: Callable[[str], bytes], names: tuple[str, str]) -> list[dict]:
    """The leaf items under a node, in order; levels, counts and high keys must agree with what the parent says."""
    items, counted = names
    out: list[dict] = []

    def visit(oid: str, level: int) -> tuple[str, int]:
        data = get(oid)
        need(oid_of(data) == oid, "corrupt")
        node = json.loads(data)
        need(node.get("level") == level, "wrong-level")
        if level == 0:
            need(node[items], "empty-node")
            out.extend(node[items])
            return node[items][-1]["path"], len(node[items])
        total = 0
        need(len(node["children"]) > 1, "one-child")
        for c in node["children"]:
            need(visit(c["oid"], level - 1) == (c["highKey"], c[counted]), "wrong-child")
            total += c[counted]
        return node["children"][-1]["highKey"], total

    need(height < MOST_LEVELS, "too-high")
    if top is not None:
        visit(top, height)
    return out


def read(root_oid: str, get: Callable[[str], bytes], content: Callable[[str], bytes], namespace: str = NAMESPACE) -> tuple[list[dict], dict]:
    """Entries and scope of a stored tree of format 3. What was read is built again, and must have the same root."""
    data = get(root_oid)
    need(oid_of(data) == root_oid, "corrupt")
    root = json.loads(data)
    scope_data = get(root["scopeOid"])
    need(oid_of(scope_data) == root["scopeOid"], "corrupt")
    stored = json.loads(scope_data)

    def text(c: dict) -> str:
        found = content(c["contentId"])
        need(oid_of(found) == c["contentId"] and len(found) == c["byteLength"], "corrupt")
        return base64.b64encode(found).decode()

    scope: dict = dict(ALL_MANAGED)
    if stored["scopeKind"] == "git":
        level, top = 0, stored["gitignoreSourceRoot"]
        if top is not None:
            level = json.loads(get(top)).get("level", 0)
        sources = _walk(top, level, get, ("sources", "sourceCount"))
        scope = {"kind": "git", **{k: stored[k] for k in ("repositoryPrefix", "evaluator", "ignoreCase")}, "gitignoreSources": [{"path": s["path"], "contentsBase64": text(s)} for s in sources]}
        scope |= {"infoExcludeBase64": text(stored["infoExclude"]), "globalExcludeBase64": text(stored["globalExclude"])}
    entries = []
    for e in _walk(root["entryMapRoot"], root["height"], get, ("entries", "entryCount")):
        if e["type"] == "symlink":
            target = content(e["targetContentId"])
            need(oid_of(target) == e["targetContentId"] and len(target) == e["targetByteLength"], "corrupt")
            e = {"path": e["path"], "type": "symlink", "target": target.decode(), "symlinkKind": e["symlinkKind"]}
        entries.append(e)
    entries, scope = manifest_of(entries, scope, 3)
    need(build(entries, scope, namespace)[0] == root_oid, "not-rebuilt")
    return entries, scope


def parse(data: bytes, namespace: str = NAMESPACE) -> tuple[int, list[dict], dict]:
    """Format, entries and scope of an inline document, whose bytes must be the canonical ones; (3, [], {}) for a root of format 3."""
    try:
        x = json.loads(data.decode())
    except ValueError:
        raise Invalid("not-json") from None
    names = {f"{namespace}-tree-v{k}": k for k in (1, 2, 3)}
    fmt = names.get(x.get("format")) if isinstance(x, dict) else None
    need(fmt, "unrecognised")
    if fmt == 3:
        need(x.get("kind") == f"{namespace}-tree-root", "unrecognised")
        return 3, [], {}
    need(set(x) == {"format", "entries", "scope"}, "fields")
    entries, scope = manifest_of(x["entries"], x["scope"], fmt)
    need(inline(entries, scope, fmt, namespace) == data, "not-canonical")
    return fmt, entries, scope


def upgrade(data: bytes, namespace: str = NAMESPACE) -> tuple[str, str | None, str | None, dict[str, bytes], dict[str, bytes]]:
    """Outcome (current, upgraded, format-incompatible, unrecognised, corrupt), reason, new root, and new objects and contents, of a
    stored tree's document. One format follows another: what format 1 allows and 2 does not, and so on, is incompatible."""
    try:
        fmt, entries, scope = parse(data, namespace)
    except Invalid as e:
        return "unrecognised" if str(e) == "unrecognised" else "corrupt", str(e), None, {}, {}
    if fmt == 3:
        return "current", None, oid_of(data), {}, {}
    try:
        while fmt < 3:
            fmt += 1
            wire = scope if scope["kind"] != "git" or fmt == 3 else {k: scope[k] for k in OLD_GIT_KEYS}
            entries, scope = manifest_of(entries, wire, fmt)
    except Invalid as e:
        return "format-incompatible", str(e), None, {}, {}
    root, objects, contents = build(entries, scope, namespace)
    return "upgraded", None, root, objects, contents


STORED = ("path", "type", "blob_oid", "mode", "target_id", "target_bytes", "symlink_kind")
NODE = "tree string, level int, node long, children int, entries long, high_key string, oid string, document binary"


def node_rows(tree: str, rows: list[tuple]) -> list[tuple]:
    return [(tree, *r) for r in rows]


def stored_columns(entries: DataFrame) -> DataFrame:
    """tree and STORED of entries (tree, path, type, blob_oid, mode, target, symlink_kind): the target of a symlink by its digest."""
    target = F.col("target")
    return entries.select("tree", "path", "type", "blob_oid", "mode", F.when(target.isNotNull(), F.sha2(target, 256)).alias("target_id"), F.octet_length(target).cast("long").alias("target_bytes"), "symlink_kind")


def map_nodes(entries: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """The nodes (NODE) of each tree's entries (tree and STORED), the root being the highest.

    Where a node ends depends on the keys before, so each tree is read in order, as a stream; open nodes alone are held. A tree has a
    million entries at most; trees are dealt to tasks.
    """
    names = [c.split()[0] for c in NODE.split(", ")]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, builder = None, None
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                if builder is None or r["tree"] != tree:
                    if builder is not None:
                        builder.finish()
                        rows += node_rows(tree, builder.out)
                    tree, builder = r["tree"], Builder(lambda level, group: entry_node(level, group, namespace), namespace)
                if r["type"] == "regular":
                    e = {"path": r["path"], "type": "regular", "blobOid": r["blob_oid"], "recreationMode": r["mode"]}
                else:
                    e = {"path": r["path"], "type": "symlink", "targetContentId": r["target_id"], "targetByteLength": r["target_bytes"], "symlinkKind": r["symlink_kind"]}
                builder.add((r["path"], e))
            rows += node_rows(tree, builder.out) if builder is not None else []
            if builder is not None:
                builder.out = []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
        if builder is not None:
            builder.finish()
            rows = node_rows(tree, builder.out)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    ordered = entries.select("tree", *STORED).repartition("tree").sortWithinPartitions("tree", "path")
    return ordered.mapInArrow(run, NODE)


def upgrades(documents: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """old_oid, outcome, reason, new_oid and objects (array of oid, document; the root last) for stored trees (oid, document binary).

    A document whose digest is not its oid is corrupt. A tree is one document, and is upgraded by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pa.list_(pa.struct([("oid", pa.string()), ("document", pa.binary())]))
        for batch in batches:
            rows = []
            for oid, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                done = upgrade(data, namespace) if oid_of(data) == oid else ("corrupt", "digest", None, {}, {})
                rows.append((oid, *done[:3], [{"oid": k, "document": v} for k, v in done[3].items()]))
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pairs)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["old_oid", "outcome", "reason", "new_oid", "objects"])

    return documents.select("oid", "document").mapInArrow(run, "old_oid string, outcome string, reason string, new_oid string, objects array<struct<oid:string,document:binary>>")
