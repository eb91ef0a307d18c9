"""Listing a folder tree level by level, and digesting files in bounded memory.

Spark's own file sources leave out empty files and names that begin with a dot or an underscore; a workspace has both, so
tasks list the folders themselves.
"""

from __future__ import annotations

import hashlib
import os
import stat
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHILD = "path string, kind string, byte_length long, links long, target string, elsewhere boolean"
#: Children that a task holds before it hands them on, and bytes of a file that it reads at a time.
ROWS, PIECE = 10_000, 1 << 20


def store_of(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri.removeprefix("file:/").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _local(folder: str, device: int) -> Iterator[tuple]:
    """name, kind, bytes, links, target and whether it lies on another device, for each child."""
    with os.scandir(os.fsencode(folder)) as found:
        for child in found:
            name = child.name.decode("utf-8", "replace")
            if name.encode() != child.name:
                yield name, "invalid-name", None, None, None, False
                continue
            try:
                s, target = child.stat(follow_symlinks=False), None
                kind = "directory" if stat.S_ISDIR(s.st_mode) else "regular" if stat.S_ISREG(s.st_mode) else "symlink" if stat.S_ISLNK(s.st_mode) else "special"
                if kind == "symlink":
                    target = os.readlink(child.path).decode("utf-8")
                yield name, kind, s.st_size, s.st_nlink, target, s.st_dev != device
            except (OSError, UnicodeDecodeError):
                yield name, "unreadable", None, None, None, False


def _remote(store, folder: str) -> Iterator[tuple]:
    from pyarrow import fs

    for info in store.get_file_info(fs.FileSelector(folder)):
        yield info.base_name, "directory" if info.type == fs.FileType.Directory else "regular", info.size, 1, None, False


def children(folders: DataFrame, root: str) -> DataFrame:
    """CHILD rows of what lies in folders (path, relative to root; empty for root itself). ``.git``, in any case, is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(root)
        base = base.rstrip("/")
        local = store.type_name == "local"
        device = os.stat(base).st_dev if local else 0
        for batch in batches:
            rows: list[tuple] = []
            for folder in batch.column(0).to_pylist():
                here = f"{base}/{folder}".rstrip("/")
                try:
                    for name, *rest in _local(here, device) if local else _remote(store, here):
                        if name.lower() != ".git":
                            # a name that isn't composed couldn't be restored byte for byte
                            kind = rest[0] if unicodedata.is_normalized("NFC", name) else "invalid-name"
                            rows.append((f"{folder}/{name}".lstrip("/"), kind, *rest[1:]))
                        if len(rows) >= ROWS:
                            yield _batch(rows)
                            rows = []
                except OSError:
                    rows.append((folder, "unreadable", None, None, None, False))
            yield _batch(rows)

    return folders.select("path").mapInArrow(run, CHILD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    names = [x.split()[0] for x in CHILD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def digests(files: DataFrame, root: str) -> DataFrame:
    """path, oid for files (path, byte_length); oid is null where a file can't be read or its length has changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(root)
        for batch in batches:
            out = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                digest, n = hashlib.sha256(), 0
                try:
                    with store.open_input_stream(f"{base.rstrip('/')}/{path}", compression=None) as f:
                        while piece := f.read(PIECE):
                            digest.update(piece)
                            n += len(piece)
                except OSError:
                    n = -1
                out.append(digest.hexdigest() if n == size else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["path", "oid"])

    return files.select("path", "byte_length").mapInArrow(run, "path string, oid string")


def width(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
