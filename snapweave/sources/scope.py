"""The scope of a workspace: which ignore files above and beside it decide what is managed, as git itself finds them."""

from __future__ import annotations

import base64
import os
import stat
import subprocess

from ..operators import formats


class ScopeError(RuntimeError):
    pass


def _git(root: str, *args: str, quiet: tuple[int, ...] = ()) -> str | None:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, env={**os.environ, "LC_ALL": "C"})
    if done.returncode in quiet:
        return None
    if done.returncode:
        raise ScopeError(done.stderr.decode("utf-8", "replace").strip())
    return done.stdout.decode("utf-8").removesuffix("\n")


def policy(path: str, links: bool) -> bytes | None:
    """The bytes of a policy file, if there is one; with ``links`` it may be a symlink."""
    try:
        s = os.stat(path, follow_symlinks=links)
    except (FileNotFoundError, NotADirectoryError):
        return None
    if not stat.S_ISREG(s.st_mode):
        raise ScopeError("a policy source is not a file")
    if s.st_size > formats.SOURCE_BYTES:
        raise ScopeError("a policy source is too large")
    with open(path, "rb") as f:
        return f.read(formats.SOURCE_BYTES + 1)


def _flag(root: str, name: str) -> bool:
    return _git(root, "config", "--type=bool", "--get", name, quiet=(1,)) == "true"


def ancestors(prefix: str) -> list[str]:
    """The ignore files of the folders strictly above a prefix, the repository's first."""
    parts = prefix.split("/") if prefix else []
    return ["/".join([*parts[:k], ".gitignore"]) for k in range(len(parts))]


def discover(root: str) -> tuple[str, str | None, dict]:
    """The workspace's real path, its repository's, and its scope: all managed outside of a work tree; else the ignore files above the
    workspace, the repository's and the user's excludes, and how git judges here."""
    real = os.path.realpath(root)
    try:
        top = _git(real, "rev-parse", "--show-toplevel")
    except ScopeError as e:
        if "not a git repository" in str(e):
            return real, None, dict(formats.ALL_MANAGED)
        raise
    top = os.path.realpath(top)
    prefix = os.path.relpath(real, top).replace(os.sep, "/")
    prefix = "" if prefix == "." else prefix
    sources = []
    for path in ancestors(prefix):
        data = policy(os.path.join(top, *path.split("/")), False)
        if data is not None:
            sources.append({"path": path, "contentsBase64": base64.b64encode(data).decode()})
    info = _git(real, "rev-parse", "--path-format=absolute", "--git-path", "info/exclude")
    everywhere = _git(real, "config", "--type=path", "--get", "core.excludesFile", quiet=(1,))
    if everywhere is None:
        home = os.environ.get("XDG_CONFIG_HOME") or (os.path.join(os.environ["HOME"], ".config") if os.environ.get("HOME") else None)
        everywhere = os.path.join(home, "git", "ignore") if home else None
    elif everywhere and not os.path.isabs(everywhere):
        everywhere = os.path.join(top, everywhere)
    text = lambda path: base64.b64encode((policy(path, True) if path else None) or b"").decode()
    scope = {
        "kind": "git", "repositoryPrefix": prefix, "evaluator": {"version": _git(real, "version"), "precomposeUnicode": _flag(real, "core.precomposeUnicode")},
        "ignoreCase": _flag(real, "core.ignoreCase"), "gitignoreSources": sources, "infoExcludeBase64": text(info), "globalExcludeBase64": text(everywhere),
    }
    return real, top, formats.scope_of(scope, 3)


def source_in(top: str, scope: dict, folder: str) -> dict | None:
    """The ignore file in a folder of the workspace, as a source of its scope; None if there is none, or everything is managed."""
    if scope["kind"] != "git":
        return None
    path = "/".join(x for x in (scope["repositoryPrefix"], formats.path_of(folder, 3, root=True), ".gitignore") if x)
    data = policy(os.path.join(top, *path.split("/")), False)
    return None if data is None else {"path": path, "contentsBase64": base64.b64encode(data).decode()}
