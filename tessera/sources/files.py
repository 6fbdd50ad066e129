"""Whole files and byte ranges by path or URI, on any store that pyarrow opens."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if ":/" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def file_size(path: str) -> int:
    store, p = _at(path)
    info = store.get_file_info(p)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return info.size


def is_file(path: str) -> bool:
    store, p = _at(path)
    return store.get_file_info(p.rstrip("/")).type == fs.FileType.File


def read_range(path: str, offset: int = 0, length: int | None = None) -> bytes:
    store, p = _at(path)
    with store.open_input_file(p) as f:
        return f.read_at(f.size() - offset if length is None else length, offset)


def create(path: str, data: bytes) -> None:
    """Writes a file under a name of its own and then gives it its name, so that a retried task never leaves half of one."""
    store, p = _at(path)
    folder, _, name = p.rpartition("/")
    store.create_dir(folder, recursive=True)
    part = f"{folder}/_{name}.{uuid.uuid4().hex}.part"  # a name that readers of the folder pass over
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, p)
