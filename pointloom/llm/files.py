"""Binary files in the shared folder, opened by URI from tasks."""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs


def located(uri: str):
    """(file system, path) of a URI; a path without a scheme is a local one."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    if "://" not in uri:
        uri = "file://" + uri
    return pafs.FileSystem.from_uri(uri)


def new_file(folder: str, suffix: str) -> str:
    """A name no other attempt uses: only files named in a committed manifest count."""
    return f"{folder}/part-{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    fs, path = located(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def open_for_reading(uri: str):
    fs, path = located(uri)
    return fs.open_input_file(path)
