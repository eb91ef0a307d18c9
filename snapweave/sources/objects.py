"""Stored records: how contents are encoded, decoded and authenticated, and the folders that hold loose objects, packs and indexes.

A record has kind, logical_id, encoding (raw, zstd-v1, delta1 or chunked-v1), decoded_length and payload. A raw or zstd-v1 payload
is the content. A delta1 payload names its base as the record so many places before it in its pack, and has instructions; a
chunked-v1 payload is the id of a recipe's root.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import is_oid
from ..operators import chunks, planning
from . import packfile
from .listing import children, store_of, width

RECORD = packfile.RECORD
KINDS = ("tree-root", "tree-node", "scope", "recipe", "content")
#: Names of a store's loose objects: a folder by kind, then the first two digits of the id.
NAMESPACES = ("legacy", "structural", "content", "recipe")
#: The largest content in one record; beyond, it is chunked.
WHOLE = 256 << 10


def compatible(kind: Column, encoding: Column) -> Column:
    """Whether a kind of record may have an encoding: deltas and chunks are for contents only."""
    return kind.isin(*KINDS) & (encoding.isin("raw", "zstd-v1") | (kind == "content") & encoding.isin("delta1", "chunked-v1"))


def pack_class(kind: Column) -> Column:
    return F.when(kind == "content", "data").when(kind.isin(*KINDS), "metadata")


def representation(length: Column, n_chunks: Column) -> Column:
    """full, or chunked for contents above the average chunk that have two chunks at least."""
    return F.when((length > chunks.AVERAGE) & (n_chunks >= 2), "chunked").otherwise("full")


def encode(contents: DataFrame) -> DataFrame:
    """Records of contents (kind, content) up to WHOLE bytes each, compressed where that saves enough. Larger ones are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import zstandard

        packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        for batch in batches:
            rows = []
            for kind, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = x or b""
                if len(x) > WHOLE:
                    raise ValueError("a content of this size must be chunked")
                small = packer.compress(x) if len(x) > 64 else x
                useful = len(x) - len(small) >= max(64, -(-len(x) * 5 // 100))
                rows.append((kind, hashlib.sha256(x).hexdigest(), "zstd-v1" if useful else "raw", len(x), small if useful else x))
            yield _records(rows)

    return contents.select("kind", "content").mapInArrow(run, RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["kind", "logical_id", "encoding", "decoded_length", "payload"])


def write_delta(back: int, steps: list[tuple]) -> bytes:
    """The payload of a delta: a version, how many records before it the base stands, the number of steps, and each step (0 copy:
    offset, length; 1 add: length, bytes)."""
    out = bytearray(b"\1" + chunks.varint(back) + chunks.varint(len(steps)))
    for s in steps:
        out += b"\1" + chunks.varint(len(s[1])) + s[1] if s[0] == "add" else b"\0" + chunks.varint(s[1]) + chunks.varint(s[2])
    return bytes(out)


def read_delta(payload: bytes) -> tuple[int, list[tuple]]:
    read = packfile.Reader(payload)
    read.expect(b"\1")
    back, n = read.number(), read.number()
    steps: list[tuple] = []
    for _ in range(n):
        code = read.take(1)
        if code == b"\1":
            steps.append(("add", read.take(read.number())))
        elif code == b"\0":
            steps.append(("copy", read.number(), read.number()))
        else:
            raise ValueError("no such instruction")
    read.end()
    return back, steps


def delta_records(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Delta records (with base_id) of pairs (target_id, base_id, target, base) that are small enough against the record of the whole
    target. In a pack a base comes right before its delta; planners that place it elsewhere write the distance anew.

    full: the record rows of the targets; a delta's saving is measured against their payload, not against the bare content.
    """
    sizes = full.select(F.col("logical_id").alias("target_id"), F.octet_length("payload").cast("long").alias("full"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for target_id, base_id, target, base, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                steps = chunks.simple_delta(base, target)
                payload = write_delta(1, steps) if steps else b""
                if steps and size - len(payload) >= 128 and (size - len(payload)) * 100 >= size * 35:
                    rows.append(("content", target_id, "delta1", len(target), payload, base_id))
            plain = _records([r[:5] for r in rows])
            yield pa.RecordBatch.from_arrays([*plain.columns, pa.array([r[5] for r in rows], pa.string())], names=[*plain.schema.names, "base_id"])

    return pairs.join(sizes, "target_id").select("target_id", "base_id", "target", "base", "full").mapInArrow(run, f"{RECORD}, base_id string")


def decode_whole(records: DataFrame) -> DataFrame:
    """kind, logical_id, content of raw and zstd-v1 records. content is null where the payload is damaged, or its length or digest is
    not the record's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for encoding, n, payload in zip(*(batch.column(k).to_pylist() for k in range(2, 5)), strict=True):
                try:
                    data = payload if encoding == "raw" else reader.decompress(payload, max_output_size=max(n, 1))
                except zstandard.ZstdError:
                    data = None
                out.append(data if data is not None and len(data) == n else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["kind", "logical_id", "data"])

    some = records.filter(F.col("encoding").isin("raw", "zstd-v1")).select("kind", "logical_id", "encoding", "decoded_length", "payload")
    data = some.mapInArrow(run, "kind string, logical_id string, data binary")
    return data.select("kind", "logical_id", F.when(F.sha2("data", 256) == F.col("logical_id"), F.col("data")).alias("content"))


def decode(records: DataFrame, recipe_edges: DataFrame) -> DataFrame:
    """kind, logical_id, content of every record (RECORD, base_id: of deltas); null where it can't be had intact.

    Deltas join the decoded base (a base is never a delta). Chunked contents flatten their recipe (recipe_edges: parent_id, ord,
    child_id, kind) and join the chunks, which are contents as well; a content's chunks meet in one group, of its own size.
    """
    whole = decode_whole(records)
    contents = whole.filter("kind = 'content'").select(F.col("logical_id").alias("base_id"), F.col("content").alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for payload, base, n in zip(*(batch.column(k).to_pylist() for k in range(2, 5)), strict=True):
                try:
                    data = None if base is None else chunks.apply_delta(base, read_delta(payload)[1])
                except (ValueError, IndexError):
                    data = None
                out.append(data if data is not None and len(data) == n else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["kind", "logical_id", "content"])

    asked = records.filter("encoding = 'delta1'")
    joined = asked.join(contents, "base_id", "left").select("kind", "logical_id", "payload", "base", "decoded_length")
    made = joined.mapInArrow(run, "kind string, logical_id string, content binary")
    chunked = records.filter("encoding = 'chunked-v1'").select(F.col("logical_id").alias("content_id"), F.lower(F.hex("payload")).alias("node_id"), "decoded_length")
    listed = planning.flatten_recipes(chunked.select("content_id", "node_id"), recipe_edges)
    parts = listed.join(contents.withColumnRenamed("base_id", "chunk_id"), "chunk_id", "left")
    glued = parts.groupBy("content_id").agg(
        F.sort_array(F.collect_list(F.struct("ord", "base"))).alias("p"), F.bool_or(F.col("base").isNull()).alias("lost")
    )
    data = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["base"]))
    whole_again = chunked.join(glued, "content_id", "left").select(F.lit("content").alias("kind"), F.col("content_id").alias("logical_id"), F.when(~F.col("lost"), data).alias("content"))
    rest = made.unionByName(whole_again)
    return whole.unionByName(rest.select("kind", "logical_id", F.when(F.sha2("content", 256) == F.col("logical_id"), F.col("content")).alias("content")))


def resolve(wanted: DataFrame, *sources: DataFrame) -> DataFrame:
    """wanted (kind, logical_id) with source (number) and content: the first of several sources (kind, logical_id, content) in which
    the object is intact; null where it is in none."""
    rows = [s.select("kind", "logical_id", F.lit(k).alias("source"), "content") for k, s in enumerate(sources)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    sound = every.filter("content is not null").filter(F.sha2("content", 256) == F.col("logical_id")).join(wanted.select("kind", "logical_id").distinct(), ["kind", "logical_id"], "left_semi")
    first = sound.groupBy("kind", "logical_id").agg(F.min_by(F.struct("source", "content"), "source").alias("f"))
    return wanted.join(first, ["kind", "logical_id"], "left").select("kind", "logical_id", "f.source", "f.content")


def stage(required: DataFrame, contents: DataFrame, folder: str, *roots: str) -> DataFrame:
    """Write required blobs (blob_oid) from contents (logical_id, content) to a scratch folder outside of the roots (the workspace, the
    store), and read them back: blob_oid, content. One that is missing or not the bytes of its oid is an error."""
    inside = [r for r in roots if f"{folder.rstrip('/')}/".startswith(f"{r.rstrip('/')}/")]
    if inside:
        raise ValueError(f"the scratch folder lies in {inside[0]}")
    both = required.select("blob_oid").distinct().join(contents.select(F.col("logical_id").alias("blob_oid"), "content"), "blob_oid", "left")
    sound = F.sha2("content", 256) == F.col("blob_oid")
    failed = F.raise_error(F.concat(F.lit("no intact blob "), F.col("blob_oid"))).cast("binary")
    both.select("blob_oid", F.when(F.coalesce(sound, F.lit(False)), F.col("content")).otherwise(failed).alias("content")).write.parquet(folder)
    return required.sparkSession.read.parquet(folder)


def locate(wanted: DataFrame, index: DataFrame, footers: DataFrame) -> DataFrame:
    """wanted (logical_id) with pack_id, offset, length and hinted: where the index (logical_id, pack_id, offset, length) says, if the
    footers (the same columns) agree; else the first place in the footers; null where there is none."""
    place = F.struct("pack_id", "offset", "length")
    there = footers.select("logical_id", place.alias("at"))
    hint = index.select("logical_id", place.alias("at")).join(there, ["logical_id", "at"], "left_semi").groupBy("logical_id").agg(F.min("at").alias("hint"))
    any_ = there.groupBy("logical_id").agg(F.min("at").alias("first"))
    met = wanted.select("logical_id").join(hint, "logical_id", "left").join(any_, "logical_id", "left").withColumn("at", F.coalesce("hint", "first"))
    return met.select("logical_id", "at.pack_id", "at.offset", "at.length", F.col("hint").isNotNull().alias("hinted"))


def loose_inventory(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """Loose objects of a store (namespace, logical_id, byte_length, temporary), and the names that don't belong (path).

    Only the listing is read. Objects lie at namespace/two digits/62 digits; names that end in .tmp are temporary.
    """
    folders = spark.range(256).select(F.explode(F.array(*map(F.lit, NAMESPACES))).alias("n"), F.lpad(F.lower(F.hex("id")), 2, "0").alias("d"))
    spaces = children(spark.createDataFrame([(n,) for n in NAMESPACES], "path string"), store)
    there = folders.select(F.concat_ws("/", "n", "d").alias("path")).join(spaces.filter("kind = 'directory'").select("path"), "path", "left_semi")
    found = children(there.repartition(width(spark), "path"), store).unionByName(spaces.join(there, "path", "left_anti"))
    part = lambda k: F.regexp_extract("path", r"^([a-z]+)/([0-9a-f]{2})/([0-9a-f]{62})(\.[0-9a-z]+\.tmp)?$", k)
    rows = found.withColumn("namespace", part(1)).withColumn("logical_id", F.concat(part(2), part(3))).withColumn("temporary", part(4) != "")
    known = is_oid(F.col("logical_id")) & (F.col("kind") == "regular")
    return rows.filter(known).select("namespace", "logical_id", "byte_length", "temporary"), rows.filter(~known).select("path")


def publish_packs(packs: DataFrame, folder: str) -> list[tuple[str, str]]:
    """Write packs (pack_id, data) as files by their id, under shared ``folder`` (a URI). (pack_id, published or existing) of each.

    A file gets its name once it is whole, so a task may run twice; a pack whose name is taken is not written again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = store_of(folder)
        store.create_dir(path, recursive=True)
        for batch in batches:
            states = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packfile.footer(data)
                there = store.get_file_info(f"{path}/{name}.pack").type == fs.FileType.File
                if not there:
                    own = f"{path}/.{name}-{uuid.uuid4().hex}"
                    with store.open_output_stream(own) as out:
                        out.write(data)
                    store.move(own, f"{path}/{name}.pack")
                states.append("existing" if there else "published")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(states)], names=["pack_id", "state"])

    return sorted(tuple(r) for r in packs.select("pack_id", "data").mapInArrow(run, "pack_id string, state string").collect())


def pack_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """The entries (packfile.ENTRY) of all packs in folder (a URI), of which the head, the footer and the trailer alone are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pack").load(folder)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.pack$", 1).alias("pack_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(folder)
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{path}/{name}.pack") as f:
                    own, kind, entries = packfile.footer_of(f)
                if own != name:
                    raise ValueError("a pack has the name of another")
                rows += [packfile.entry_row(name, kind, e) for e in entries]
            yield packfile.entry_batch(rows)

    return named.mapInArrow(run, packfile.ENTRY)


def read_records(spark: SparkSession, folder: str, places: DataFrame) -> DataFrame:
    """pack_id, ordinal and the record at places (packfile.ENTRY), each read from its place alone; a pack is opened once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(folder)
        name, file = None, None
        for batch in batches:
            rows, packs, ordinals = [], [], []
            for r in batch.to_pylist():
                if r["pack_id"] != name:
                    if file is not None:
                        file.close()
                    name, file = r["pack_id"], store.open_input_file(f"{path}/{r['pack_id']}.pack")
                entry = packfile.Entry(r["logical_id"], packfile.KINDS[r["kind"]], packfile.ENCODINGS[r["encoding"]], r["ordinal"], r["decoded_length"], r["offset"], r["length"])
                rows.append(packfile.record_at(file.read_at(r["length"], r["offset"]), entry))
                packs.append(name)
                ordinals.append(r["ordinal"])
            plain = _records(rows)
            yield pa.RecordBatch.from_arrays([pa.array(packs, pa.string()), pa.array(ordinals, pa.int32()), *plain.columns], names=["pack_id", "ordinal", *plain.schema.names])

    return places.repartition("pack_id").sortWithinPartitions("pack_id", "offset").mapInArrow(run, f"pack_id string, ordinal int, {RECORD}")


def with_bases(records: DataFrame) -> DataFrame:
    """records (pack_id, ordinal, RECORD) with base_id: of a delta, the id of the record so many places before it in its pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = [packfile.Reader(p, 1).number() for p in batch.column("payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(back, pa.int32())], names=["pack_id", "ordinal", "logical_id", "back"])

    deltas = records.filter("encoding = 'delta1'").select("pack_id", "ordinal", "logical_id", "payload").mapInArrow(run, "pack_id string, ordinal int, logical_id string, back int")
    asked = records.select("pack_id", "ordinal", "logical_id").join(deltas.select("pack_id", "ordinal", "back"), ["pack_id", "ordinal"], "left")
    return records.join(planning.delta_chain(asked), ["pack_id", "logical_id"], "left")


def write_index(entries: DataFrame, sizes: DataFrame, uri: str) -> None:
    """Publish the index of pack entries (packfile.ENTRY) and sizes (pack_id, bytes) as a file; it gets its name once it is whole."""
    store, path = store_of(uri)
    folder = path.rsplit("/", 1)[0]
    store.create_dir(folder, recursive=True)
    own = f"{folder}/.index-{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(packfile.index_of(entries, sizes))
    store.move(own, path)


def read_index(spark: SparkSession, uri: str, footers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A stored index as entries (packfile.ENTRY), and how it differs from the footers (planning.index_differences()); it is current if
    that is empty."""
    store, path = store_of(uri)
    with store.open_input_file(path) as f:
        packs, entries = packfile.decode_index(f.read())
    rows = [packfile.entry_row(*packs[e.pack][:2], e) for e in entries]
    stored = spark.createDataFrame(entry_table(rows))
    return stored, planning.index_differences(stored, footers.select(*stored.columns))


def entry_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([packfile.entry_batch(rows)])
