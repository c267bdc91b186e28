"""Files in the shared folder, opened by executors through pyarrow's file systems."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; a bare path is local."""
    return pafs.FileSystem.from_uri(uri if ":/" in uri else os.path.abspath(uri))


@contextmanager
def writing(uri: str):
    """A stream whose file appears under its name when it is whole: a lost task leaves no half of it."""
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        yield out
    fs.move(part, path)


@contextmanager
def reading(uri: str):
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as found:
        yield found
