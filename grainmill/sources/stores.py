"""Files on any store that Arrow knows, for Python data sources."""

from __future__ import annotations

import fnmatch
import posixpath
import re


def filesystem(path: str):
    """The store of a path, and the path inside it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def matching_files(pattern: str) -> list[tuple[str, int]]:
    """(path, size) of the files of a folder, or of those that a pattern of names matches.

    Wildcards may be in the last part of the path only. Names that begin with ``.`` or ``_`` are
    not data.
    """
    from pyarrow import fs

    store, inner = filesystem(pattern)
    scheme = pattern[: len(pattern) - len(inner)] if pattern.endswith(inner) else ""
    folder, wanted = posixpath.split(inner)
    if not any(c in wanted for c in "*?["):
        info = store.get_file_info(inner)
        if info.type == fs.FileType.File:
            return [(scheme + inner, info.size)]
        folder, wanted = inner, "*"
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(
        (scheme + f.path, f.size)
        for f in found
        if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, wanted) and f.base_name[0] not in "._"
    )
