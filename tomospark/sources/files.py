"""Files by path or URI: mounted ones by the operating system, others by pyarrow's file systems (s3, gs, hdfs, ...)."""

from __future__ import annotations

import fnmatch
import glob
import os
import re

_URI = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://")


def _system(path: str):
    """A URI's file system, the path in it, and what stands before that path in the URI."""
    from pyarrow import fs

    path = path.rstrip("/")
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path.removesuffix(inner)


def opened(path: str):
    """A seekable binary file."""
    if not _URI.match(path):
        return open(path, "rb")  # noqa: SIM115
    system, inner, _ = _system(path)
    return system.open_input_file(inner)


def entries(path: str) -> list[tuple[str, bool]]:
    """(path, whether it is a directory) of what a directory holds, by name."""
    if not _URI.match(path):
        return [(p, os.path.isdir(p)) for x in sorted(os.listdir(path)) if (p := os.path.join(path, x))]
    from pyarrow import fs

    system, inner, before = _system(path)
    found = system.get_file_info(fs.FileSelector(inner))
    return sorted((before + f.path, f.type == fs.FileType.Directory) for f in found)


def is_dir(path: str) -> bool:
    if not _URI.match(path):
        return os.path.isdir(path)
    from pyarrow import fs

    system, inner, _ = _system(path)
    return system.get_file_info(inner).type == fs.FileType.Directory


def matched(pattern: str) -> list[str]:
    """Paths that a glob names, by name; wildcards hold within a level."""
    if not _URI.match(pattern):
        return sorted(glob.glob(pattern))
    if not re.search(r"[*?\[]", pattern):
        from pyarrow import fs

        system, inner, _ = _system(pattern)
        return [pattern] if system.get_file_info(inner).type != fs.FileType.NotFound else []
    at = re.search(r"[*?\[]", pattern).start()
    base = pattern[:at].rsplit("/", 1)[0]
    levels, found = pattern[len(base) + 1 :].split("/"), [base]
    for level in levels:
        found = [p for b in found if is_dir(b) for p, _ in entries(b) if fnmatch.fnmatchcase(p.rsplit("/", 1)[-1], level)]
    return sorted(found)
