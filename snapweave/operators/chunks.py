"""Content kernels: content-defined chunks, recipes over them, payload encodings, and simple deltas.

These need the bytes or sequential state, so they run over Arrow batches. Contents are cut as streams: at most one chunk of the largest
size is held besides the piece that comes in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written

#: Fixed values of the chunking profile.
MINIMUM, AVERAGE, MAXIMUM = 16 << 10, 64 << 10, 256 << 10
MASK_BEFORE, MASK_AFTER = 0x3FFFF, 0x3FFF
GEAR_SEED = 0x243F6A88
#: Children of a recipe leaf and of a recipe branch.
LEAF_FANOUT, BRANCH_FANOUT = 768, 480
#: Simple deltas are for contents of this size at most.
DELTA_MAXIMUM = 256 << 10
#: Fixed values of recipe objects: marks, the format's version, the chunking profile, and codes of nodes and references.
ROOT_MARK, NODE_MARK, RECIPE_VERSION, PROFILE = b"CYRR", b"CYRN", 1, 1
LEAF, BRANCH, TO_CHUNK, TO_NODE = 1, 2, 1, 2
RECIPE_MAXIMUM, RECIPE_DEPTH = 32 << 10, 8
#: Ids of recipe objects are digests of a tag and the bytes; the tag begins with the name of the product that wrote the store.
NAMESPACE = "snapweave"


def gear_table() -> np.ndarray:
    """256 values of a 32-bit xorshift generator."""
    out, x = [], GEAR_SEED
    for _ in range(256):
        x ^= x << 13 & 0xFFFFFFFF
        x ^= x >> 17
        x ^= x << 5 & 0xFFFFFFFF
        out.append(x)
    return np.array(out, np.uint32)


def first_cut(data: np.ndarray, gear: np.ndarray) -> int:
    """Where the first chunk of data (bytes, up to the largest chunk's) ends, if no more than these follow or they are that many.

    The rolling sum begins at the minimum and doubles with each byte, so after 32 bytes a byte's part has left the 32-bit word: the
    value at a position is the sum of the last 32 shifted table values. The masks change at the average.
    """
    if len(data) <= MINIMUM:
        return len(data)
    for low, high, mask in ((MINIMUM, min(AVERAGE, len(data)), MASK_BEFORE), (AVERAGE, min(MAXIMUM, len(data)), MASK_AFTER)):
        if low < high:
            begin = max(MINIMUM, low - 31)
            shifted = gear[data[begin:high]]
            rolling = np.zeros(len(shifted), np.uint32)
            for k in range(min(32, len(shifted))):
                rolling[k:] += shifted[: len(shifted) - k] << np.uint32(k)
            hits = np.flatnonzero(rolling[low - begin :] & np.uint32(mask) == 0)
            if len(hits):
                return low + int(hits[0])
    return min(MAXIMUM, len(data))


class Chunker:
    """Cuts a content that comes in pieces of any size: push() and finish() give the chunks' bytes as soon as their end is known.

    Chunks are the same however the content is split.
    """

    def __init__(self):
        self.held, self.gear = bytearray(), gear_table()

    def push(self, piece: bytes) -> Iterator[bytes]:
        for at in range(0, len(piece), MAXIMUM):
            self.held += piece[at : at + MAXIMUM]
            while len(self.held) >= MAXIMUM:
                yield self._take()

    def finish(self) -> Iterator[bytes]:
        while self.held:
            yield self._take()

    def _take(self) -> bytes:
        end = first_cut(np.frombuffer(bytes(self.held[:MAXIMUM]), np.uint8), self.gear)
        out = bytes(self.held[:end])
        del self.held[:end]
        return out


def pieces(data: bytes) -> Iterator[bytes]:
    """The chunks of a whole content."""
    chunker = Chunker()
    yield from chunker.push(data)
    yield from chunker.finish()


def boundaries(data: bytes) -> list[int]:
    """Lengths of the chunks of data."""
    return [len(c) for c in pieces(data)]


def chunk(contents: DataFrame) -> DataFrame:
    """content_id, ord, offset, length, chunk_id of each chunk of contents (content_id, content). Null content has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at = 0
                for k, c in enumerate(pieces(value.as_py() or b"")):
                    rows.append((key, k, at, len(c), hashlib.sha256(c).hexdigest()))
                    at += len(c)
            names = ["content_id", "ord", "offset", "length", "chunk_id"]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], names=names)

    return contents.select("content_id", "content").mapInArrow(run, "content_id string, ord long, offset long, length long, chunk_id string")


def chunk_pieces(pieces: DataFrame) -> DataFrame:
    """content_id, ord, offset, length, chunk_id of contents that come as rows of pieces (content_id, ord, piece) of any size.

    A content is one stream, read in order; at most one chunk and one batch of it are held. Contents are dealt to tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chunker, k, at = None, None, 0, 0

        def rows_of(found: Iterator[bytes]) -> list[tuple]:
            nonlocal k, at
            out = []
            for c in found:
                out.append((key, k, at, len(c), hashlib.sha256(c).hexdigest()))
                k, at = k + 1, at + len(c)
            return out

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], names=["content_id", "ord", "offset", "length", "chunk_id"])

        for batch in batches:
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if chunker is None or name != key:
                    if chunker is not None:
                        yield batch_of(rows_of(chunker.finish()))
                    key, chunker, k, at = name, Chunker(), 0, 0
                found = rows_of(chunker.push(piece.as_py() or b""))
                if found:
                    yield batch_of(found)
        if chunker is not None:
            yield batch_of(rows_of(chunker.finish()))

    ordered = pieces.select("content_id", "piece", "ord").repartition("content_id").sortWithinPartitions("content_id", "ord").select("content_id", "piece")
    return ordered.mapInArrow(run, "content_id string, ord long, offset long, length long, chunk_id string")


def digests(pieces: DataFrame) -> DataFrame:
    """content_id, oid, length: the digest over each content's pieces (content_id, ord, piece) in order, a running one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, n, out = None, None, 0, []
        for batch in batches:
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest is None or name != key:
                    out += [(key, digest.hexdigest(), n)] if digest is not None else []
                    key, digest, n = name, hashlib.sha256(), 0
                data = piece.as_py() or b""
                digest.update(data)
                n += len(data)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int64())], names=["content_id", "oid", "length"])
            out = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([digest.hexdigest()]), pa.array([n], pa.int64())], names=["content_id", "oid", "length"])

    ordered = pieces.select("content_id", "piece", "ord").repartition("content_id").sortWithinPartitions("content_id", "ord").select("content_id", "piece")
    return ordered.mapInArrow(run, "content_id string, oid string, length long")


def recipe_levels(chunks: DataFrame) -> DataFrame:
    """content_id, level, node, children, length: the nodes of each content's recipe, leaves (level 0) up to the root.

    Built bottom up by division of ord; each level has far fewer rows than the one below.
    """
    level = chunks.groupBy("content_id", F.floor(F.col("ord") / LEAF_FANOUT).alias("node")).agg(F.count("*").alias("children"), F.sum("length").alias("length"))
    level = level.select("content_id", F.lit(0).alias("level"), "node", "children", "length")
    out, depth = level, 0
    while depth < 8 and not level.filter("node > 0").isEmpty():
        depth += 1
        tall = level.groupBy("content_id").agg(F.max("node").alias("most")).filter("most > 0").select("content_id")
        up = level.join(tall, "content_id").groupBy("content_id", F.floor(F.col("node") / BRANCH_FANOUT).alias("node"))
        level = up.agg(F.count("*").alias("children"), F.sum("length").alias("length")).select("content_id", F.lit(depth).alias("level"), "node", "children", "length")
        out = out.unionByName(level)
    return out


def recipe_id(data: bytes, namespace: str = NAMESPACE) -> str:
    return hashlib.sha256(f"{namespace}.recipe.v1\0".encode() + data).hexdigest()


def _reference(node: tuple) -> bytes:
    """node: id, decoded length, depth, nodes, chunks."""
    return bytes([TO_NODE]) + bytes.fromhex(node[0]) + b"".join(map(varint, node[1:]))


def encode_leaf(chunks: list[tuple[str, int]]) -> bytes:
    """A recipe node over chunks (id, length)."""
    if not 0 < len(chunks) <= LEAF_FANOUT or any(not 0 < n <= MAXIMUM for _, n in chunks):
        raise ValueError("a leaf has 1 to 768 chunks")
    head = NODE_MARK + bytes([RECIPE_VERSION, LEAF]) + varint(sum(n for _, n in chunks)) + varint(len(chunks))
    return head + b"".join(bytes([TO_CHUNK]) + bytes.fromhex(c) + varint(n) for c, n in chunks)


def encode_branch(nodes: list[tuple]) -> bytes:
    """A recipe node over nodes (id, decoded length, depth, nodes, chunks)."""
    if not 0 < len(nodes) <= BRANCH_FANOUT or len({n[2] for n in nodes}) != 1:
        raise ValueError("a branch has 1 to 480 nodes of one depth")
    return NODE_MARK + bytes([RECIPE_VERSION, BRANCH]) + varint(sum(n[1] for n in nodes)) + varint(len(nodes)) + b"".join(map(_reference, nodes))


def encode_root(content_id: str, child: tuple) -> bytes:
    if child[1] <= AVERAGE or child[4] < 2 or child[2] + 1 > RECIPE_DEPTH:
        raise ValueError("chunked contents exceed 64 KiB, have two chunks at least, and a bounded depth")
    return ROOT_MARK + bytes([RECIPE_VERSION, PROFILE]) + bytes.fromhex(content_id) + varint(child[1]) + _reference(child)


def decode_recipe(data: bytes) -> tuple[str, str | None, int, list[tuple]]:
    """Kind (leaf, branch or root), content id (of a root), decoded length and references of a recipe object; canonical bytes only."""
    if len(data) > RECIPE_MAXIMUM or len(data) < 7:
        raise ValueError("not a recipe object")
    mark, code, at, content = data[:4], data[5], 6, None
    if data[4] != RECIPE_VERSION or (mark, code) not in ((ROOT_MARK, PROFILE), (NODE_MARK, LEAF), (NODE_MARK, BRANCH)):
        raise ValueError("not a recipe object")
    kind = "root" if mark == ROOT_MARK else "leaf" if code == LEAF else "branch"
    try:
        if kind == "root":
            content, at = data[at : at + 32].hex(), at + 32
        length, at = read_varint(data, at)
        n, at = (1, at) if kind == "root" else read_varint(data, at)
        out: list[tuple] = []
        for _ in range(n):
            if data[at] != (TO_CHUNK if kind == "leaf" else TO_NODE):
                raise ValueError("no such reference")
            ref, at = [data[at + 1 : at + 33].hex()], at + 33
            for _ in range(1 if kind == "leaf" else 4):
                x, at = read_varint(data, at)
                ref.append(x)
            out.append(tuple(ref))
    except IndexError:
        raise ValueError("cut short") from None
    again = encode_root(content, out[0]) if kind == "root" else encode_leaf(out) if kind == "leaf" else encode_branch(out)
    if at != len(data) or again != data or length != sum(r[1] for r in out):
        raise ValueError("not canonical")
    return kind, content, length, out


RECIPE_NODE = "content_id string, level int, node long, recipe_id string, decoded_length long, depth int, nodes long, chunks long, document binary"


def _recipe_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in RECIPE_NODE.split(", ")])


def recipe_objects(chunks: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """The recipe objects (RECIPE_NODE; level -1 is the root) of contents (content_id, ord, length, chunk_id) above 64 KiB that have two
    chunks at least.

    Leaves are groups of 768 chunks by division of ord, branches of 480 nodes; every group is bounded by these. Levels shrink fast.
    """
    sums = chunks.groupBy("content_id").agg(F.sum("length").alias("sum"), F.count("*").alias("n")).filter((F.col("sum") > AVERAGE) & (F.col("n") > 1))
    own = chunks.join(sums.select("content_id"), "content_id", "left_semi")

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content, node, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = encode_leaf([(r["chunk_id"], r["length"]) for r in x])
                rows.append((content, 0, node, recipe_id(data, namespace), sum(r["length"] for r in x), 1, 1, len(x), data))
            yield _recipe_rows(rows)

    def branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content, level, node, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                below = [(r["recipe_id"], r["decoded_length"], r["depth"], r["nodes"], r["chunks"]) for r in x]
                data = encode_branch(below)
                rows.append((content, level, node, recipe_id(data, namespace), sum(b[1] for b in below), below[0][2] + 1, 1 + sum(b[3] for b in below), sum(b[4] for b in below), data))
            yield _recipe_rows(rows)

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = encode_root(content, (x["recipe_id"], x["decoded_length"], x["depth"], x["nodes"], x["chunks"]))
                rows.append((content, -1, 0, recipe_id(data, namespace), x["decoded_length"], x["depth"] + 1, x["nodes"] + 1, x["chunks"], data))
            yield _recipe_rows(rows)

    grouped = own.groupBy("content_id", F.floor(F.col("ord") / LEAF_FANOUT).alias("node")).agg(F.array_sort(F.collect_list(F.struct("ord", "chunk_id", "length"))).alias("x"))
    level = written(grouped.mapInArrow(leaves, RECIPE_NODE), "recipe")
    out, depth = level, 0
    fields = ["node", "recipe_id", "decoded_length", "depth", "nodes", "chunks"]
    while depth < RECIPE_DEPTH and not level.filter("node > 0").isEmpty():
        depth += 1
        tall = level.filter("node > 0").select("content_id").distinct()
        up = level.join(tall, "content_id", "left_semi").groupBy("content_id", F.lit(depth).alias("level"), F.floor(F.col("node") / BRANCH_FANOUT).alias("up"))
        level = written(up.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("x")).mapInArrow(branches, RECIPE_NODE), "recipe")
        out = out.unionByName(level)
    tops = out.groupBy("content_id").agg(F.max_by(F.struct(*fields), "level").alias("x"))
    return out.unionByName(tops.mapInArrow(roots, RECIPE_NODE))


def recipe_edges(objects: DataFrame, namespace: str = NAMESPACE) -> tuple[DataFrame, DataFrame]:
    """The references (parent_id, ord, child_id, kind node or chunk, length) of recipe objects (recipe_id, document), and the problems
    (recipe_id, rule): objects that are not the bytes of their id, or not canonical."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    if recipe_id(data, namespace) != name:
                        raise ValueError("the digest is another")
                    kind, _, _, refs = decode_recipe(data)
                    rows += [(name, k, r[0], "chunk" if kind == "leaf" else "node", r[1], None) for k, r in enumerate(refs)]
                except ValueError as e:
                    rows.append((name, None, None, None, None, str(e)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["parent_id", "ord", "child_id", "kind", "length", "rule"])

    found = objects.select("recipe_id", "document").dropDuplicates(["recipe_id"]).mapInArrow(run, "parent_id string, ord long, child_id string, kind string, length long, rule string")
    found = written(found, "recipe-edges")
    return found.filter("rule is null").drop("rule"), found.filter("rule is not null").select(F.col("parent_id").alias("recipe_id"), "rule")


def recipe_problems(chunks: DataFrame, lengths: DataFrame) -> DataFrame:
    """rule, content_id: recipes of one chunk, chunks of a wrong size, and sums that miss the content's length."""
    ends = chunks.groupBy("content_id").agg(F.max("ord").alias("last"), F.count("*").alias("n"), F.sum("length").alias("sum"))
    few = ends.filter("n < 2").select(F.lit("few-chunks").alias("rule"), "content_id")
    size = chunks.join(ends.select("content_id", "last"), "content_id").filter((F.col("length") > MAXIMUM) | (F.col("length") < MINIMUM) & (F.col("ord") < F.col("last")))
    total = ends.join(lengths, "content_id").filter(F.col("sum") != F.col("decoded_length"))
    return few.unionByName(size.select(F.lit("chunk-size").alias("rule"), "content_id").distinct()).unionByName(total.select(F.lit("length").alias("rule"), "content_id"))


def payloads(contents: DataFrame) -> DataFrame:
    """content_id, encoding (raw or zstd-v1), length: compressed where it saves 64 bytes and 5 percent; 64 bytes or fewer stay raw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        for batch in batches:
            kinds, sizes = [], []
            for x in batch.column(1).to_pylist():
                n = len(x or b"")
                small = len(packer.compress(x)) if n > 64 else n
                useful = n - small >= max(64, -(-n * 5 // 100))
                kinds.append("zstd-v1" if useful else "raw")
                sizes.append(small if useful else n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds), pa.array(sizes, pa.int64())], names=["content_id", "encoding", "length"])

    return contents.select("content_id", "content").mapInArrow(run, "content_id string, encoding string, length long")


def varint(n: int) -> bytes:
    """Unsigned LEB128."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The value at a position, and where it ends. An encoding longer than needed is refused."""
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            if shift and not b:
                raise ValueError("not the shortest encoding")
            return n, at
        shift += 7


def common_ends(base: bytes, target: bytes) -> tuple[int, int]:
    """Lengths of the common prefix and, of what remains of the shorter, the common suffix."""
    n = min(len(base), len(target))
    a, b = np.frombuffer(base, np.uint8), np.frombuffer(target, np.uint8)
    differ = np.flatnonzero(a[:n] != b[:n])
    prefix = int(differ[0]) if len(differ) else n
    rest = n - prefix
    differ = np.flatnonzero(a[len(a) - rest :][::-1] != b[len(b) - rest :][::-1])
    return prefix, int(differ[0]) if len(differ) else rest


def simple_delta(base: bytes, target: bytes) -> list[tuple] | None:
    """Copy, add, copy: the instructions that make target of base, or None where there is nothing to gain from trying."""
    if not target or base == target or max(len(base), len(target)) > DELTA_MAXIMUM:
        return None
    prefix, suffix = common_ends(base, target)
    steps = [("copy", 0, prefix), ("add", target[prefix : len(target) - suffix]), ("copy", len(base) - suffix, suffix)]
    return [s for s in steps if (len(s[1]) if s[0] == "add" else s[2])]


def apply_delta(base: bytes, steps: list[tuple]) -> bytes:
    return b"".join(s[1] if s[0] == "add" else base[s[1] : s[1] + s[2]] for s in steps)


def delta_bytes(steps: list[tuple]) -> int:
    """Bytes of the written instructions: a code, then lengths and offsets as varints, then added bytes."""
    return sum(1 + (len(varint(len(s[1]))) + len(s[1]) if s[0] == "add" else len(varint(s[1])) + len(varint(s[2]))) for s in steps)


def deltas(pairs: DataFrame) -> DataFrame:
    """content_id, prefix, added, suffix, useful for pairs (content_id, base, target) that have a delta."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, base, target in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                steps = simple_delta(base or b"", target or b"")
                if steps is not None:
                    prefix, suffix = common_ends(base or b"", target)
                    full, small = len(target), delta_bytes(steps)
                    rows.append((key, prefix, full - prefix - suffix, suffix, full - small >= 128 and (full - small) * 100 >= full * 35))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], names=["content_id", "prefix", "added", "suffix", "useful"])

    return pairs.select("content_id", "base", "target").mapInArrow(run, "content_id string, prefix long, added long, suffix long, useful boolean")
