"""Files in the shared folder, written and read by tasks through Arrow's filesystems.

Works for every URI scheme that pyarrow.fs knows (file, s3, gs, hdfs).
"""

from __future__ import annotations

import uuid
from typing import BinaryIO

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def make_dir(uri: str) -> None:
    where, path = _at(uri)
    where.create_dir(path, recursive=True)


def create(uri: str) -> BinaryIO:
    where, path = _at(uri)
    return where.open_output_stream(path, compression=None)


def open_read(uri: str) -> BinaryIO:
    where, path = _at(uri)
    return where.open_input_stream(path, compression=None)


def open_random(uri: str) -> BinaryIO:
    where, path = _at(uri)
    return where.open_input_file(path)


def size(uri: str) -> int:
    """Bytes of a file; -1 if there is none."""
    where, path = _at(uri)
    info = where.get_file_info(path)
    return info.size if info.type == fs.FileType.File else -1


def rename(old: str, new: str) -> None:
    """Idempotent: a rename that another attempt has done already is no error."""
    where, a = _at(old)
    b = _at(new)[1]
    if where.get_file_info(a).type == fs.FileType.File:
        where.move(a, b)
    elif where.get_file_info(b).type != fs.FileType.File:
        raise FileNotFoundError(old)


def put(uri: str, data: bytes) -> None:
    """Write under a temporary name, then rename."""
    temporary = f"{uri}.{uuid.uuid4().hex[:8]}.tmp"
    with create(temporary) as f:
        f.write(data)
    rename(temporary, uri)


def get(uri: str) -> bytes:
    with open_read(uri) as f:
        return f.read()


def files(uri: str, suffix: str) -> list[BinaryIO]:
    """The files of a folder whose names end so, opened; none if there is no folder."""
    where, path = _at(uri)
    found = where.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return [where.open_input_file(x.path) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and x.base_name.endswith(suffix)]
