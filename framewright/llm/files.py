"""Files in the shared folder, written and read by executors through Arrow's file systems (file:, hdfs:, s3:, gs:)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _resolve(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def folder(uri: str) -> str:
    """Make a folder; returns its URI."""
    at, path = _resolve(uri)
    at.create_dir(path, recursive=True)
    return uri


def publish(uri: str, write) -> int:
    """Write a file under a name of this attempt's own and move it to `uri` when it is whole; returns its bytes.

    A repeated attempt writes the same content again; readers use only names that a committed manifest holds.
    """
    at, path = _resolve(uri)
    draft = f"{path}.{uuid.uuid4().hex}"
    with at.open_output_stream(draft) as out:
        write(out)
        size = out.tell()
    at.move(draft, path)
    return size


def read_range(uri: str, start: int, end: int | None = None) -> bytes:
    at, path = _resolve(uri)
    with at.open_input_file(path) as f:
        return f.read_at((f.size() if end is None else end) - start, start)


def size(uri: str) -> int:
    at, path = _resolve(uri)
    return at.get_file_info(path).size
