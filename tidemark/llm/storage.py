"""Files that executors write into, and read from, the shared folder, through any file system pyarrow knows."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def _open(uri: str):
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@contextmanager
def new_file(folder: str, stem: str, suffix: str):
    """Yields (stream, uri) of a new file whose name no other attempt of the same task can have.

    Only attempts that Spark commits get their uri into a manifest, so what a lost or repeated attempt leaves
    is never read.
    """
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"
    with system.open_output_stream(f"{path}/{name}", compression=None) as out:
        yield out, f"{folder}/{name}"


def read_stream(uri: str):
    """A sequential stream of the file's raw bytes."""
    system, path = _open(uri)
    return system.open_input_stream(path, compression=None, buffer_size=1 << 20)


def read_file(uri: str):
    """A random-access file."""
    system, path = _open(uri)
    return system.open_input_file(path)
