"""Files that tasks write to and read from the shared folder.

A task writes under a name of its own and reports it in its output rows. Only files that are
in the written table of those rows count, so a task that runs twice does no harm.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder, made if missing. `uri` may be a plain path."""
    if "://" in uri or uri.startswith("file:/"):
        if uri.startswith("file:/") and not uri.startswith("file://"):
            uri = "file://" + uri[len("file:"):]
        fs, path = pafs.FileSystem.from_uri(uri)
    else:
        fs, path = pafs.LocalFileSystem(), uri
    fs.create_dir(path, recursive=True)
    return fs, path.rstrip("/")


def new_name(stem: str, suffix: str) -> str:
    return f"{stem}-{uuid.uuid4().hex}{suffix}"


def read_exactly(stream, size: int) -> bytes:
    data = stream.read(size)
    if len(data) != size:
        raise EOFError(f"file ends {size - len(data)} bytes early")
    return data
