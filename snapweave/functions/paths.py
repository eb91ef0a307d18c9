"""Column functions on workspace paths (slash-separated, relative, compared as UTF-8 bytes)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_BYTES = 65_536
MAX_COMPONENTS = 256


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ancestors(path: Column) -> Column:
    """Every strict ancestor directory, shallowest first; empty for a path of one component."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def at_or_below(path: Column, root: Column) -> Column:
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def has_git_component(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda c: F.lower(c) == ".git")


def violation(path: Column) -> Column:
    """The first rule that a path breaks, or null."""
    parts = F.split(path, "/")
    return (
        F.when(path == "", "empty")
        .when(path.contains("\0") | path.contains("\\"), "unsafe-character")
        .when(path.startswith("/"), "absolute")
        .when(F.octet_length(path) > MAX_BYTES, "too-long")
        .when(F.size(parts) > MAX_COMPONENTS, "too-deep")
        .when(F.exists(parts, lambda c: (c == "") | (c == ".") | (c == "..")), "unsafe-component")
        .when(has_git_component(path), "git-component")
    )


def object_path(oid: Column) -> Column:
    return F.concat_ws("/", F.substring(oid, 1, 2), F.substring(oid, 3, 62))


def is_oid(oid: Column) -> Column:
    return oid.rlike("^[0-9a-f]{64}$")


def local_path(path: Column, prefix: Column) -> Column:
    """path without the repository prefix; null outside of it."""
    return F.when(prefix == "", path).when(path.startswith(F.concat(prefix, F.lit("/"))), F.substring(path, F.char_length(prefix) + 2, F.char_length(path)))


def fold_key(text: str) -> str:
    for _ in range(2):
        text = unicodedata.normalize("NFC", text).upper().lower()
    return unicodedata.normalize("NFC", text)


def _fold(series: pd.Series) -> pd.Series:
    return series.map(lambda p: None if p is None else fold_key(p))


def portable_key(path: Column) -> Column:
    """A key that paths share if some file system may take them for one. ASCII paths stay in the JVM."""
    return F.when(path.rlike(r"^[\x00-\x7F]*$"), F.lower(path)).otherwise(F.pandas_udf(_fold, StringType())(path))


def utf16_key(path: Column) -> Column:
    """A key that sorts as the UTF-16 code units of a path do; above U+FFFF that differs from the order of its bytes."""
    return F.encode(path, "UTF-16BE")


def git_key(path: Column, ignore_case: Column) -> Column:
    """The key by which git tells paths apart where case is ignored, or the path itself."""
    return F.when(ignore_case, F.lower(path)).otherwise(path)


def store_path(root: Column, workspace: Column) -> Column:
    """Where the store of a workspace (its real path) lies below root; null for a path that isn't absolute and plain."""
    plain = workspace.startswith("/") & ~workspace.contains("\0") & ~workspace.rlike("//|/\\.{1,2}(/|$)|.+/$")
    return F.when(plain, F.concat_ws("/", F.rtrim(root, F.lit("/")), F.sha2(workspace, 256)))


def message_of(error: object) -> str:
    """A text for whatever was raised, even if it can't be printed."""
    try:
        return str(error.args[0] if isinstance(error, BaseException) and len(error.args) == 1 else error)
    except Exception:  # what is printed may be hostile
        return "unprintable failure"


def varint_length(n: Column) -> Column:
    """Bytes of n as unsigned LEB128: 7 bits a byte, one at least."""
    return F.ceil(F.length(F.bin(n)) / 7).cast("int")
