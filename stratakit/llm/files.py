"""Binary files in the shared folder, written and read by tasks.

A task gives each file a name of its own attempt and reports it as a row; the
written table of those rows is what commits them, so files of attempts that were
lost or repeated are never read.
"""

from __future__ import annotations

import os
import shutil
import uuid
from typing import IO
from urllib.parse import unquote, urlparse

import pyarrow.fs
from pyspark import TaskContext


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def attempt_name(kind: str, seq: int) -> str:
    return f"{kind}-{TaskContext.get().partitionId():06d}-{seq:06d}-{uuid.uuid4().hex}"


def create(uri: str) -> IO[bytes]:
    """A new file; folders above it are made."""
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "xb")  # noqa: SIM115
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path)


def opened(uri: str) -> IO[bytes]:
    """A file to read from its start, in pieces."""
    if path := _local(uri):
        return open(path, "rb")  # noqa: SIM115
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path)


def size(uri: str) -> int:
    if path := _local(uri):
        return os.path.getsize(path)
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    return system.get_file_info(path).size


def replace(uri: str, data: bytes) -> None:
    """A whole file under a name that does not depend on the attempt; it is there whole or not at all."""
    part = f"{uri}.{uuid.uuid4().hex}"
    with create(part) as f:
        f.write(data)
    if path := _local(uri):
        os.replace(_local(part), path)
    else:
        system, path = pyarrow.fs.FileSystem.from_uri(uri)
        system.move(pyarrow.fs.FileSystem.from_uri(part)[1], path)


def read_if_there(uri: str) -> bytes:
    """A whole file, or nothing where there is none."""
    try:
        with opened(uri) as f:
            return f.read()
    except FileNotFoundError:
        return b""


def remove(uri: str) -> None:
    """Delete a folder, if it is there."""
    if path := _local(uri):
        shutil.rmtree(path, ignore_errors=True)
        return
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    if system.get_file_info(path).type == pyarrow.fs.FileType.Directory:
        system.delete_dir(path)
