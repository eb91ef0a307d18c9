"""SimHash near-duplicates: bit-sliced comparison inside candidate blocks, then connected components.

Fingerprints are 64 bits over 3-word shingles. Two fingerprints that differ in at most two bits agree in two of four 16-bit
quarters, so every link lies inside one of six blocks keyed by 32 bits. Blocks of more than ``HOT`` distinct fingerprints are
keyed further by a third of their free bits at a time (again, two differing bits leave one third equal), twice at most, after
which 2^15 fingerprints are the most a block can hold; so no block is capped and no link is lost. Inside a block the bits are
stored as vertical planes (one long integer a bit, one lane a member); one member is compared with all others at once by
carry-save counters, and the scan of planes stops once every lane exceeds the radius.

Null or empty texts, and texts without words, have fingerprint 0 and link like any other. Repeated rows and exact copies
share a fingerprint and so a component; an empty table gives an empty result. A component without any non-null doc_id has a
null component_id. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, whole_row

RADIUS = 2
SHINGLE = 3
#: Distinct fingerprints in a block beyond which it is divided.
HOT = 4096
FULL = (1 << 64) - 1


def fingerprint(text: bytes | None) -> int:
    """The majority bits of the XXH64 hashes (seed 42) of all 3-word shingles, repeats included."""
    import xxhash

    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - SHINGLE] + 1))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and ``fp``: the fingerprint as a signed long."""
    schema = docs.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter(map(fingerprint, batch.column("_t").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    return docs.select(*keep, F.col("text").cast("binary").alias("_t")).mapInArrow(run, schema)


def _thirds(mask: int) -> list[int]:
    bits = [b for b in range(64) if mask >> b & 1]
    k = len(bits)
    return [sum(1 << b for b in bits[k * i // 3 : k * (i + 1) // 3]) for i in range(3)]


def block_masks() -> list[list[tuple[int, int]]]:
    """By level: (parent's number, the mask of the bits that members of the block share). Level 0 has six blocks."""
    quarter = [0xFFFF << 16 * i for i in range(4)]
    levels = [[(-1, quarter[a] | quarter[b]) for a in range(4) for b in range(a)]]
    while len(levels) < 3:
        levels.append([(i, m | t) for i, (_, m) in enumerate(levels[-1]) for t in _thirds(FULL & ~m)])
    return levels


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_sliced_links(members: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that span the components of one block: (member, a linked member's root), positions in members (distinct uint64)."""
    m = len(members)
    vary = int(np.bitwise_or.reduce(members ^ members[0]))
    bits = [b for b in range(64) if vary >> b & 1]
    table = np.unpackbits(members.view(np.uint8).reshape(m, 8), axis=1, bitorder="little")[:, bits]
    planes = [int.from_bytes(x.tobytes(), "little") for x in np.packbits(table.T, axis=1, bitorder="little")]
    lanes = (1 << m) - 1
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(m - 1):
        over = lanes & ((2 << i) - 1)  # lanes up to i are done
        # carry-save counters of two bits: c1 c0; what carries out of them, or reaches radius + 1, is over
        c0 = c1 = 0
        for plane in planes:
            differs = ~plane & lanes if plane >> i & 1 else plane
            carry = c0 & differs
            c0 ^= differs
            over |= c1 & carry
            c1 ^= carry
            if radius < 3:
                over |= c1 & c0 if radius == 2 else c1 if radius == 1 else c1 | c0
            if over == lanes:
                break
        near = lanes & ~over
        while near:
            low = near & -near
            near ^= low
            a, b = find(i), find(low.bit_length() - 1)
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in range(m) if find(x) != x]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        us, vs = [], []
        for i in range(batch.num_rows):
            members = np.sort(batch.column(0)[i].values.to_numpy(zero_copy_only=False).astype(np.int64))
            for a, b in bit_sliced_links(members.view(np.uint64)):
                us.append(members[a])
                vs.append(members[b])
        yield pa.RecordBatch.from_arrays([pa.array(np.array(us, np.int64)), pa.array(np.array(vs, np.int64))], names=["u", "v"])


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (u, v) among distinct fingerprints (column fp) that span every component of fingerprints within the radius."""
    found, rows = None, None
    for level, masks in enumerate(block_masks()):
        value = lambda m: F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("val")
        if rows is None:
            rows = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("blk"), value(m)) for k, (_, m) in enumerate(masks)))).alias("k"))
        else:
            parts = F.array(*(F.struct(F.lit(k).alias("blk"), F.lit(p).alias("parent"), value(m)) for k, (p, m) in enumerate(masks)))
            rows = rows.select("fp", F.explode(F.filter(parts, lambda x: x["parent"] == F.col("blk"))).alias("k"))
        rows = rows.select("fp", "k.blk", "k.val")
        size = rows.groupBy("blk", "val").agg(F.count("*").alias("n")).filter("n > 1")
        rows = cut(rows.join(size, ["blk", "val"]), "blocks")
        last = level == len(block_masks()) - 1
        small = rows if last else rows.filter(F.col("n") <= hot)
        groups = small.groupBy("blk", "val").agg(F.collect_list("fp").alias("fps")).select("fps")
        some = groups.mapInArrow(_compare, "u long, v long")
        found = some if found is None else found.unionByName(some)
        rows = rows.filter(F.col("n") > hot).select("fp", "blk", "val")
        if last or rows.isEmpty():
            return found.distinct()
    raise AssertionError


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of the undirected edges (u, v) that isn't itself its component's smallest node.

    Alternating large-star and small-star steps; each is cut to the shared folder. Sums by node are combined before the
    shuffle, and joins back to the edges are ones that skewed partitions can be split in.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        small = cut(small, "small")
        discard(large)
        discard(now)
        mark = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = small
        if mark == before:
            return now.select("u", F.col("v").alias("root"))
        before = mark


def classes(tagged: DataFrame, hot: int = HOT) -> DataFrame:
    """fp, root, component_id for every distinct fp of tagged (doc_id, fp)."""
    fps = cut(tagged.groupBy("fp").agg(F.min("doc_id").alias("low")), "fps")
    roots = components(links(fps.select("fp"), hot))
    mapped = fps.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = mapped.groupBy("root").agg(F.min("low").alias("component_id"))
    return mapped.select("fp", "root").join(lowest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id for every row of docs (doc_id, text)."""
    tagged = cut(fingerprints(docs, ["doc_id"]), "fingerprints")
    return tagged.join(classes(tagged, hot).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row of each component, one with the smallest doc_id (nulls last); the columns of docs.

    Rows are told apart by two hashes of doc_id and text, so that the text is shuffled once, by a key that is never hot.
    """
    hashes = [F.xxhash64("doc_id", "text").alias("_k"), F.hash(F.lit(7), "text", "doc_id").alias("_i")]
    tagged = cut(fingerprints(docs.select("doc_id", "text", *hashes), ["doc_id", "_k", "_i"]), "fingerprints")
    groups = classes(tagged, hot).select("fp", "root")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k", "_i")
    keep = tagged.join(groups, "fp").groupBy("root").agg(F.min(order).alias("k")).select("k._k", "k._i")
    one = docs.select(whole_row(docs), *hashes).join(keep, ["_k", "_i"], "left_semi")
    return one.dropDuplicates(["_k", "_i"]).select("row.*")
