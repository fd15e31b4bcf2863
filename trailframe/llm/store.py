"""Files of the operators' own formats, by any path that pyarrow can open."""

from __future__ import annotations

import ctypes
import re

import pyarrow as pa
from pyarrow import fs


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; Hadoop's one-slash ``file:/x`` and ``s3a`` are taken too."""
    path = re.sub(r"^file:/+", "/", path)
    path = re.sub(r"^s3a://", "s3://", path)
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def list_files(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below, hidden and unfinished ones left out."""
    store, where = open_store(path)
    info = store.get_file_info(where)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = store.get_file_info(fs.FileSelector(where, recursive=True, allow_not_found=True))
    names = [(f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix)]
    return sorted((p, n) for p, n in names if not p.rsplit("/", 1)[-1].startswith((".", "_")))


def give_back() -> None:
    """Return a task's freed memory to the system: its worker lives on beside other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
