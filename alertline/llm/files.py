"""Binary files in the shared folder, written and read inside tasks."""

from __future__ import annotations

import re
import uuid

import pyarrow.fs


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. A path without a scheme is a local one."""
    if uri.startswith("file:"):
        uri = "file:///" + re.sub("^file:/*", "", uri)
    elif "://" not in uri:
        return pyarrow.fs.LocalFileSystem(), uri
    return pyarrow.fs.FileSystem.from_uri(uri)


def new_name(part: int, suffix: str) -> str:
    """A file name that no other attempt of the same task uses."""
    return f"part-{part:06d}-{uuid.uuid4().hex}{suffix}"
