"""Bytes of stored records, packs and multi-pack indexes: canonical layouts, written and read by tasks, whole packs at a time.

All integers are unsigned LEB128 in their shortest form, ids 32 bytes. Whatever is not the one spelling that a value has is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import read_varint, varint

#: Fixed values of the formats.
RECORD_MAGIC = b"CYRC"
PACK_MAGIC, FOOTER_MAGIC, TRAILER_MAGIC = b"CYPACK01", b"CYPFTR01", b"CYPTRL01"
INDEX_MAGIC, INDEX_TRAILER_MAGIC = b"CYMIDX01", b"CYMTRL01"
VERSION, NO_FLAGS = 1, 0
KINDS = {"content": 1, "recipe": 2, "tree-root": 3, "tree-node": 4, "scope": 5}
ENCODINGS = {"raw": 0, "zstd-v1": 1, "chunked-v1": 2, "delta1": 3}
CLASSES = {"data": 1, "metadata": 2}
MOST_RECORDS, MOST_PACKS, MOST_ENTRIES = 65_535, 65_535, 1_000_000
DATA_MAXIMUM, METADATA_MAXIMUM, INDEX_MAXIMUM = 64 << 20, (256 << 20) + (1 << 20), 64 << 20
#: Of a metadata pack with two records or more.
METADATA_SHARED_MAXIMUM = 32 << 20
#: The footer's length, the checksum and the mark behind it.
TRAILER = 8 + 32 + 8


class Record(NamedTuple):
    kind: str
    logical_id: str
    encoding: str
    decoded_length: int
    payload: bytes


class Entry(NamedTuple):
    """Where a pack holds a record; entries compare as the footer sorts them."""

    logical_id: str
    kind: int
    encoding: int
    ordinal: int
    decoded_length: int
    offset: int
    length: int


KIND_NAMES, ENCODING_NAMES, CLASS_NAMES = ({v: k for k, v in x.items()} for x in (KINDS, ENCODINGS, CLASSES))


def class_of(kind: str) -> str:
    return "data" if kind == "content" else "metadata"


class Reader:
    """Takes values off some bytes; reading beyond their end, or a value that isn't allowed, is a ValueError."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def expect(self, what: bytes) -> None:
        if self.take(len(what)) != what:
            raise ValueError("not the expected mark")

    def number(self) -> int:
        try:
            n, self.at = read_varint(self.data, self.at)
        except IndexError:
            raise ValueError("cut short") from None
        return n

    def one_of(self, names: dict[int, str]) -> str:
        code = self.take(1)[0]
        if code not in names:
            raise ValueError("no such code")
        return names[code]

    def digest(self) -> str:
        return self.take(32).hex()

    def end(self) -> None:
        if self.at != len(self.data):
            raise ValueError("trailing bytes")


def encode_record(r: Record) -> bytes:
    if r.encoding in ("chunked-v1", "delta1") and r.kind != "content":
        raise ValueError("only contents are chunked or deltas")
    if r.encoding == "raw" and len(r.payload) != r.decoded_length:
        raise ValueError("a raw payload has another length")
    head = RECORD_MAGIC + bytes([VERSION, KINDS[r.kind], ENCODINGS[r.encoding]]) + varint(NO_FLAGS)
    return head + bytes.fromhex(r.logical_id) + varint(r.decoded_length) + varint(len(r.payload)) + r.payload


def decode_record(data: bytes) -> Record:
    read = Reader(data)
    read.expect(RECORD_MAGIC + bytes([VERSION]))
    kind, encoding = read.one_of(KIND_NAMES), read.one_of(ENCODING_NAMES)
    read.expect(varint(NO_FLAGS))
    logical_id, length = read.digest(), read.number()
    out = Record(kind, logical_id, encoding, length, read.take(read.number()))
    read.end()
    if encode_record(out) != data:
        raise ValueError("not canonical")
    return out


def fan_out(ids: Iterable[str]) -> list[int]:
    """For each first byte of an id, how many ids begin with it or a smaller one."""
    counts = [0] * 256
    for x in ids:
        counts[int(x[:2], 16)] += 1
    return list(accumulate(counts))


def _footer(entries: list[Entry]) -> bytes:
    out = bytearray(FOOTER_MAGIC + bytes([VERSION]) + varint(NO_FLAGS) + varint(len(entries)))
    for n in fan_out(e.logical_id for e in entries):
        out += varint(n)
    for e in sorted(entries):
        out += bytes.fromhex(e.logical_id) + bytes([e.kind, e.encoding]) + varint(e.decoded_length) + varint(e.ordinal) + varint(e.offset) + varint(e.length)
    return bytes(out)


def _header(kind: str, n: int) -> bytes:
    return PACK_MAGIC + bytes([VERSION, CLASSES[kind]]) + varint(NO_FLAGS) + varint(n)


def encode(records: list[Record]) -> tuple[str, bytes]:
    """The id (the checksum before the last mark) and the bytes of a pack of records of one class, in their order."""
    kinds = {class_of(r.kind) for r in records}
    if len(kinds) != 1 or len(records) > MOST_RECORDS:
        raise ValueError(f"a pack holds 1 to {MOST_RECORDS} records of one class")
    if len({r[:3] for r in records}) < len(records):
        raise ValueError("a record is given twice")
    kind = kinds.pop()
    out, entries = bytearray(_header(kind, len(records))), []
    for k, r in enumerate(records):
        body = encode_record(r)
        frame = varint(len(body)) + body
        entries.append(Entry(r.logical_id, KINDS[r.kind], ENCODINGS[r.encoding], k, r.decoded_length, len(out), len(frame)))
        out += frame
    footer = _footer(entries)
    out += footer + len(footer).to_bytes(8, "big")
    checksum = hashlib.sha256(out).digest()
    out += checksum + TRAILER_MAGIC
    if len(out) > (DATA_MAXIMUM if kind == "data" else METADATA_MAXIMUM if len(records) == 1 else METADATA_SHARED_MAXIMUM):
        raise ValueError("a pack of this size is not allowed")
    return checksum.hex(), bytes(out)


def packed_length(records: list[Record]) -> int:
    """The length that encode() gives."""
    return len(encode(records)[1])


def _entries(footer: bytes, most_end: int) -> list[Entry]:
    read = Reader(footer)
    read.expect(FOOTER_MAGIC + bytes([VERSION]) + varint(NO_FLAGS))
    n = read.number()
    if n > MOST_RECORDS:
        raise ValueError("too many records")
    fan = [read.number() for _ in range(256)]
    out = []
    for _ in range(n):
        logical_id, kind, encoding = read.digest(), KINDS[read.one_of(KIND_NAMES)], ENCODINGS[read.one_of(ENCODING_NAMES)]
        length, ordinal, offset, size = (read.number() for _ in range(4))
        out.append(Entry(logical_id, kind, encoding, ordinal, length, offset, size))
    read.end()
    if out != sorted(out) or fan != fan_out(e.logical_id for e in out):
        raise ValueError("the footer is not in order")
    at = None
    for k, e in enumerate(sorted(out, key=lambda e: e.ordinal)):
        if e.ordinal != k or at is not None and e.offset != at:
            raise ValueError("records don't follow one another")
        at = e.offset + e.length
    if n and at != most_end:
        raise ValueError("records don't reach the footer")
    return out


def footer_of(file) -> tuple[str, str, list[Entry]]:
    """Id, class and entries of a pack, from the head, the footer and the trailer of an open file alone.

    The id is the checksum as it is written; decode() recomputes it.
    """
    size = file.size()
    if size < len(_header("data", 1)) + TRAILER:
        raise ValueError("not a pack")
    trailer = file.read_at(TRAILER, size - TRAILER)
    length = int.from_bytes(trailer[:8], "big")
    if trailer[40:] != TRAILER_MAGIC or length > size - TRAILER:
        raise ValueError("not a pack")
    end = size - TRAILER - length
    entries = _entries(file.read_at(length, end), end)
    head = file.read_at(min(32, size), 0)
    read = Reader(head)
    read.expect(PACK_MAGIC + bytes([VERSION]))
    kind = read.one_of(CLASS_NAMES)
    read.expect(varint(NO_FLAGS))
    if read.number() != len(entries) or not entries or min(e.offset for e in entries) != read.at or any(class_of(KIND_NAMES[e.kind]) != kind for e in entries):
        raise ValueError("head and footer differ")
    return trailer[8:40].hex(), kind, entries


def footer(data: bytes) -> tuple[str, str, list[Entry]]:
    """footer_of() a whole pack, after its checksum is recomputed."""
    found = footer_of(pa.BufferReader(data))
    if hashlib.sha256(data[: -40]).hexdigest() != found[0]:
        raise ValueError("the checksum is another")
    return found


def record_at(frame: bytes, entry: Entry) -> Record:
    """The record in a frame, which must be what its entry says."""
    read = Reader(frame)
    r = decode_record(read.take(read.number()))
    read.end()
    if (r.logical_id, KINDS[r.kind], ENCODINGS[r.encoding], r.decoded_length) != (entry.logical_id, entry.kind, entry.encoding, entry.decoded_length):
        raise ValueError("record and entry differ")
    return r


def decode(data: bytes) -> tuple[str, str, list[Record]]:
    """Id, class and records, in their order in the pack."""
    name, kind, entries = footer(data)
    return name, kind, [record_at(data[e.offset : e.offset + e.length], e) for e in sorted(entries, key=lambda e: e.ordinal)]


class IndexEntry(NamedTuple):
    """Of a multi-pack index; compares as the index sorts them."""

    logical_id: str
    kind: int
    encoding: int
    pack: int
    offset: int
    ordinal: int
    decoded_length: int
    length: int


def encode_index(packs: list[tuple[str, str, int, list[Entry]]]) -> bytes:
    """The index over packs (id, class, bytes, entries)."""
    packs = sorted(packs, key=lambda p: p[0])
    if len({p[0] for p in packs}) < len(packs) or len(packs) > MOST_PACKS:
        raise ValueError("packs are given twice, or too many")
    entries = sorted(IndexEntry(e.logical_id, e.kind, e.encoding, k, e.offset, e.ordinal, e.decoded_length, e.length) for k, p in enumerate(packs) for e in p[3])
    if len(entries) > MOST_ENTRIES:
        raise ValueError("too many entries")
    out = bytearray(INDEX_MAGIC + bytes([VERSION]) + varint(NO_FLAGS) + varint(len(packs)) + varint(len(entries)))
    for name, kind, size, _ in packs:
        out += bytes.fromhex(name) + bytes([CLASSES[kind]]) + varint(size)
    for n in fan_out(e.logical_id for e in entries):
        out += varint(n)
    for e in entries:
        out += bytes.fromhex(e.logical_id) + bytes([e.kind, e.encoding]) + b"".join(map(varint, (e.decoded_length, e.pack, e.ordinal, e.offset, e.length)))
    out += hashlib.sha256(out).digest() + INDEX_TRAILER_MAGIC
    if len(out) > INDEX_MAXIMUM:
        raise ValueError("the index is too large")
    return bytes(out)


def decode_index(data: bytes) -> tuple[list[tuple[str, str, int]], list[IndexEntry]]:
    """Packs (id, class, bytes) and entries of an index, which must be the one spelling of both."""
    body = data[: -40]
    if len(data) > INDEX_MAXIMUM or len(data) < 40 or data[-8:] != INDEX_TRAILER_MAGIC or hashlib.sha256(body).digest() != data[-40:-8]:
        raise ValueError("not an intact index")
    read = Reader(body)
    read.expect(INDEX_MAGIC + bytes([VERSION]) + varint(NO_FLAGS))
    n_packs, n = read.number(), read.number()
    if n_packs > MOST_PACKS or n > MOST_ENTRIES:
        raise ValueError("too many packs or entries")
    packs = [(read.digest(), read.one_of(CLASS_NAMES), read.number()) for _ in range(n_packs)]
    fan = [read.number() for _ in range(256)]
    entries = []
    for _ in range(n):
        logical_id, kind, encoding = read.digest(), KINDS[read.one_of(KIND_NAMES)], ENCODINGS[read.one_of(ENCODING_NAMES)]
        length, pack, ordinal, offset, size = (read.number() for _ in range(5))
        entries.append(IndexEntry(logical_id, kind, encoding, pack, offset, ordinal, length, size))
    read.end()
    if packs != sorted(packs) or entries != sorted(entries) or fan != fan_out(e.logical_id for e in entries) or any(e.pack >= n_packs for e in entries):
        raise ValueError("the index is not in order")
    return packs, entries


def look_up(entries: list[IndexEntry], fan: list[int], logical_id: str, kind: str) -> list[IndexEntry]:
    """Entries of an id and kind: the fan-out narrows to the ids of one first byte, halving finds the id."""
    from bisect import bisect_left

    first = int(logical_id[:2], 16)
    at = bisect_left(entries, logical_id, fan[first - 1] if first else 0, fan[first], key=lambda e: e.logical_id)
    out = []
    while at < len(entries) and entries[at].logical_id == logical_id:
        out += [entries[at]] if entries[at].kind == KINDS[kind] else []
        at += 1
    return out


RECORD = "kind string, logical_id string, encoding string, decoded_length long, payload binary"
ENTRY = "pack_id string, class string, logical_id string, kind string, encoding string, decoded_length long, ordinal int, offset long, length long"


def entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    names = [c.split()[0] for c in ENTRY.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def entry_row(name: str, kind: str, e: Entry) -> tuple:
    return name, kind, e.logical_id, KIND_NAMES[e.kind], ENCODING_NAMES[e.encoding], e.decoded_length, e.ordinal, e.offset, e.length


def pack(records: DataFrame) -> DataFrame:
    """pack_id, class, data: a pack for each batch of records (batch, RECORD), in order of kind, id and encoding. A batch is bounded by the
    planner, and by the format."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = [Record(*r) for r in zip(*(table[c].to_pylist() for c in Record._fields), strict=True)]
        rows.sort(key=lambda r: (KINDS[r.kind], r.logical_id, ENCODINGS[r.encoding]))
        name, data = encode(rows)
        return pa.table({"pack_id": [name], "class": [class_of(rows[0].kind)], "data": pa.array([data], pa.binary())})

    return records.select("batch", *Record._fields).groupBy("batch").applyInArrow(run, "pack_id string, class string, data binary")


def read(spark: SparkSession, folder: str, verify=None) -> DataFrame:
    """pack_id and the record of every record of the packs in folder; a damaged pack fails the read, and so does a record that
    verify(record), a handler that the caller may give, refuses."""

    def run(batches):
        for batch in batches:
            rows = [(name, *r) for d in batch.column(0).to_pylist() for name, _, found in [decode(d)] for r in found]
            if verify is not None and not all(verify(Record(*r[1:])) for r in rows):
                raise ValueError("a record is refused")
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["pack_id", *Record._fields])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pack").load(folder).select("content")
    return files.mapInArrow(run, f"pack_id string, {RECORD}")


def index_of(entries: DataFrame, sizes: DataFrame) -> bytes:
    """The bytes of the index over pack entries (ENTRY) and their packs' sizes (pack_id, bytes). The format holds MOST_ENTRIES at most."""
    most = entries.limit(MOST_ENTRIES + 1)
    packs: dict[str, tuple[str, list[Entry]]] = {}
    for r in most.collect():
        packs.setdefault(r["pack_id"], (r["class"], []))[1].append(Entry(r.logical_id, KINDS[r.kind], ENCODINGS[r.encoding], r.ordinal, r.decoded_length, r.offset, r["length"]))
    length = {r[0]: r[1] for r in sizes.select("pack_id", "bytes").limit(MOST_PACKS + 1).collect()}
    return encode_index([(name, kind, length[name], found) for name, (kind, found) in packs.items()])
