"""Which paths a git work tree manages, as git itself judges; no second matcher is kept here."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH = 2048


def ignored(paths: list[str], root: str) -> set[str]:
    """Of paths below root, those that git ignores, asked 2,048 at a time."""
    out: set[str] = set()
    for i in range(0, len(paths), BATCH):
        asked = "\0".join(paths[i : i + BATCH])
        done = subprocess.run(["git", "-C", root, "check-ignore", "--no-index", "-z", "--stdin"], input=asked.encode(), capture_output=True)
        if done.returncode not in (0, 1):
            raise RuntimeError(done.stderr.decode("utf-8", "replace"))
        out |= {x for x in done.stdout.decode().split("\0") if x}
    return out


def managed(paths: DataFrame, root: str) -> DataFrame:
    """path, managed for every row of paths (path). root must be readable by every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            out = ignored(names, root)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n not in out for n in names], pa.bool_())], names=["path", "managed"])

    return paths.select("path").mapInArrow(run, "path string, managed boolean")
