"""Files of a shared store, opened by URI from the driver and from tasks."""

from __future__ import annotations

import re

import pyarrow.fs as pafs


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a path without a scheme is a local one."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    if "://" not in uri:
        uri = "file://" + ("" if uri.startswith("/") else "/") + uri
    return pafs.FileSystem.from_uri(uri)


def listed(uri: str) -> list[tuple[str, int]]:
    """Path and size of every file below a folder; none if there is no such folder."""
    fs, path = located(uri)
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File)
