"""Metadata databases: read in one transaction, their schema compared text by text, identities inspected, registries with flags."""

from __future__ import annotations

import os
import re
import sqlite3
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import slots

#: The tables of the current version, and their version number.
VERSION = 3
TABLES = {
    "checkpoint_slot": "CREATE TABLE checkpoint_slot(session_id TEXT NOT NULL, entry_id TEXT NOT NULL, tree_oid TEXT, capture_state TEXT NOT NULL CHECK(capture_state IN ('open', 'blocked')), "
    "PRIMARY KEY(session_id, entry_id), CHECK(tree_oid IS NOT NULL OR capture_state = 'blocked')) STRICT, WITHOUT ROWID",
    "session_capture_barrier": "CREATE TABLE session_capture_barrier(session_id TEXT NOT NULL PRIMARY KEY) STRICT, WITHOUT ROWID",
    "session_registry": "CREATE TABLE session_registry(session_id TEXT NOT NULL PRIMARY KEY, session_file TEXT NOT NULL UNIQUE, "
    "registration_state TEXT NOT NULL CHECK(registration_state IN ('pending', 'verified'))) STRICT, WITHOUT ROWID",
}
COLUMNS = {
    "checkpoint_slot": "session_id string, entry_id string, tree_oid string, capture_state string",
    "session_capture_barrier": "session_id string",
    "session_registry": "session_id string, session_file string, registration_state string",
}
#: Rows that are fetched at a time.
ROWS = 100_000
QUOTED = r"'(?:''|[^'])*'|\"(?:\"\"|[^\"])*\"|`(?:``|[^`])*`|\[[^\]]*\]"


def normalized_sql(text: str | None) -> str:
    """A schema's SQL with one blank for white space, none around brackets and commas; what is quoted stays as it is."""
    out = []
    for part in re.split(f"({QUOTED})", text or ""):
        out.append(part if re.fullmatch(QUOTED, part) else re.sub(r"\s*([(),])\s*", r"\1", re.sub(r"\s+", " ", part)))
    return "".join(out).strip()


def normalized(text: Column) -> Column:
    """normalized_sql() of a column of texts without quoted white space, brackets or commas."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"\s*([(),])\s*", "$1"))


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True, isolation_level=None)


def schema_problems(db: sqlite3.Connection, tables: dict[str, str] = TABLES, version: int = VERSION) -> list[tuple[str, str]]:
    """(name, problem) by which a database's schema is not the expected one: its version, and each object's kind and normalized SQL."""
    found = {r[1]: r for r in db.execute("select type, name, tbl_name, sql from sqlite_schema where type in ('trigger', 'view') or name not glob 'sqlite_*'")}
    out = [] if db.execute("pragma user_version").fetchone()[0] == version else [("", "version")]
    out += [(n, "unexpected") for n in found if n not in tables] + [(n, "missing") for n in tables if n not in found]
    out += [(n, "other") for n, sql in tables.items() if n in found and (found[n][0] != "table" or found[n][2] != n or normalized_sql(found[n][3]) != normalized_sql(sql))]
    return sorted(out)


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a database, all as of one moment: one read transaction on the driver. The schema must be the expected one."""
    db, out = _open(path), {}
    try:
        db.execute("begin")
        problems = schema_problems(db)
        if problems:
            raise ValueError(f"the schema is not the expected one: {problems}")
        for name, columns in COLUMNS.items():
            names = ", ".join(c.split()[0] for c in columns.split(", "))
            rows, frame = db.execute(f"select {names} from {name}"), None
            while some := rows.fetchmany(ROWS):
                part = spark.createDataFrame(some, columns)
                frame = part if frame is None else frame.unionByName(part)
            out[name] = frame if frame is not None else spark.createDataFrame([], columns)
    finally:
        db.close()
    return out


def inspect(path: str, session_id: str, session_file: str) -> str:
    """What a database, read only, says of an identity: absent, exact, conflict, newer (a later version), unrecognized, or
    recovery-required, where a journal beside it must be played back first, which a reader does not do."""
    if os.path.exists(f"{path}-journal") and os.path.getsize(f"{path}-journal"):
        return "recovery-required"
    db = _open(path)
    try:
        db.execute("begin")
        if db.execute("pragma user_version").fetchone()[0] > VERSION:
            return "newer"
        if schema_problems(db):
            return "unrecognized"
        rows = db.execute("select session_id, session_file from session_registry where session_id = ? or session_file = ?", (session_id, session_file)).fetchall()
        return "absent" if not rows else "exact" if rows == [(session_id, session_file)] else "conflict"
    finally:
        db.close()


def with_barrier(registry: DataFrame, barriers: DataFrame) -> DataFrame:
    """registry (session_id, ...) with capture_barrier: whether the session has a barrier."""
    flag = barriers.select("session_id").distinct().withColumn("b", F.lit(True))
    return registry.join(flag, "session_id", "left").withColumn("capture_barrier", F.col("b").isNotNull()).drop("b")


def orphans(sessions: DataFrame, table: DataFrame, barriers: DataFrame) -> DataFrame:
    """session_id, has_slot, has_barrier for sessions (session_id): whether any slot or barrier of theirs exists."""
    has = lambda df, name: df.select("session_id").distinct().withColumn(name, F.lit(True))
    both = sessions.select("session_id").join(has(table, "has_slot"), "session_id", "left").join(has(barriers, "has_barrier"), "session_id", "left")
    return both.select("session_id", F.coalesce("has_slot", F.lit(False)).alias("has_slot"), F.coalesce("has_barrier", F.lit(False)).alias("has_barrier"))


def register_writer_protocol(spark: SparkSession, name: str, version: int = VERSION) -> None:
    """A SQL function without arguments that gives the protocol number of this writer, for checks before a write."""
    if not re.fullmatch(r"[a-z_][a-z0-9_]*", name):
        raise ValueError("not a function name")
    spark.sql(f"create or replace temporary function {name}() returns int return {int(version)}")


def lock_order(stores: DataFrame) -> DataFrame:
    """stores (device, inode, path) in the order in which they must be locked, each physical store once, by its first path."""
    first = stores.groupBy("device", "inode").agg(F.min("path").alias("path"))
    return first.orderBy("device", "inode", "path")


match_identity = slots.match_identity
