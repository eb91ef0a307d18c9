"""Settings and the maintenance schedule: small JSON files that the driver reads and writes, and their overlay."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from .listing import store_of

MIB = 1 << 20
SAFE = (1 << 53) - 1
#: The defaults, by name.
DEFAULTS = {
    "storageDir": None, "maxFileBytes": 50 * MIB, "maxSnapshotBytes": 2048 * MIB, "maxEntries": 100_000, "maxManifestBytes": 64 * MIB, "maxPathBytes": 65_536,
    "maxPathComponents": 256, "lockTimeoutMs": 5_000, "autoGcIntervalMs": 86_400_000, "locale": "auto",
}
#: The largest that a setting may be.
MOST = {"maxEntries": 1_000_000, "maxManifestBytes": 256 * MIB, "maxPathBytes": MIB, "maxPathComponents": 4096}
GLOBAL_ONLY = ("storageDir", "locale")


class SettingsError(ValueError):
    pass


def _whole(least: int, most: int = SAFE) -> Callable:
    def check(x: object) -> int:
        if isinstance(x, bool) or not isinstance(x, int | float) or x != x or math.isinf(x) or x != int(x) or not least <= x <= most:
            raise SettingsError(f"not a whole number from {least} to {most}")
        return int(x)

    return check


def _mebibytes(most: int = SAFE) -> Callable:
    def check(x: object) -> int:
        if isinstance(x, bool) or not isinstance(x, int | float) or not math.isfinite(x) or x <= 0 or not 0 < math.floor(x * MIB) <= most:
            raise SettingsError("not a positive size in range")
        return math.floor(x * MIB)

    return check


def _text(x: object) -> str:
    if not isinstance(x, str) or not x.strip():
        raise SettingsError("not a text")
    return x


def _locale(x: object) -> str:
    if x not in ("auto", "en", "zh-CN"):
        raise SettingsError("no such locale")
    return x


#: By name in a file: the setting, and what checks and converts it.
RULES = {
    "storageDir": ("storageDir", _text),
    "maxFileMiB": ("maxFileBytes", _mebibytes()),
    "maxSnapshotMiB": ("maxSnapshotBytes", _mebibytes()),
    "maxEntries": ("maxEntries", _whole(1, MOST["maxEntries"])),
    "maxManifestMiB": ("maxManifestBytes", _mebibytes(MOST["maxManifestBytes"])),
    "maxPathBytes": ("maxPathBytes", _whole(1, MOST["maxPathBytes"])),
    "maxPathComponents": ("maxPathComponents", _whole(1, MOST["maxPathComponents"])),
    "lockTimeoutMs": ("lockTimeoutMs", _whole(1)),
    "locale": ("locale", _locale),
}


def parse(data: bytes, workspace: bool = False) -> dict[str, object]:
    """The settings that a file sets. It must be strict UTF-8 and a JSON object; unknown names are ignored; a workspace's may not set
    those that hold for all."""
    try:
        root = json.loads(data.decode("utf-8"))
    except ValueError as e:
        raise SettingsError("not UTF-8 JSON") from e
    if not isinstance(root, dict):
        raise SettingsError("not an object")
    if workspace and any(k in root for k in GLOBAL_ONLY):
        raise SettingsError(f"a workspace may not set {' or '.join(GLOBAL_ONLY)}")
    out = {}
    for name, (setting, check) in RULES.items():
        if name in root:
            try:
                out[setting] = check(root[name])
            except SettingsError as e:
                raise SettingsError(f"{name}: {e}") from None
    if "gc" in root:
        if not isinstance(root["gc"], dict):
            raise SettingsError("gc: not an object")
        if "intervalMs" in root["gc"]:
            out["autoGcIntervalMs"] = _whole(0)(root["gc"]["intervalMs"])
    return out


def _read(uri: str) -> bytes | None:
    store, path = store_of(uri)
    try:
        with store.open_input_file(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


def load(global_uri: str, workspace_uri: str | None = None) -> dict[str, object]:
    """Defaults, under what the global file sets, under what the workspace's sets. A file that isn't there sets nothing."""
    out = dict(DEFAULTS)
    for uri, workspace in ((global_uri, False), (workspace_uri, True)):
        data = _read(uri) if uri else None
        out |= parse(data, workspace) if data is not None else {}
    return out


def last_run(uri: str) -> int:
    """The time in milliseconds at which automatic maintenance last ran; 0 if it never did. A file that can't be read is an error."""
    data = _read(uri)
    if data is None:
        return 0
    try:
        x = json.loads(data.decode("utf-8"))
        if not isinstance(x, dict) or set(x) != {"lastGcAt"}:
            raise SettingsError("not a schedule")
        return _whole(0)(x["lastGcAt"])
    except ValueError as e:
        raise SettingsError("the schedule is unreadable") from e


def write_last_run(uri: str, at: int) -> None:
    """Replace the schedule at once: the file gets its name when it is whole."""
    store, path = store_of(uri)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with store.open_output_stream(own) as f:
            f.write(f'{{"lastGcAt":{_whole(0)(at)}}}\n'.encode())
        store.move(own, path)
    except BaseException:
        from pyarrow import fs

        if store.get_file_info(own).type == fs.FileType.File:
            store.delete_file(own)
        raise
