"""Files as streams inside tasks, on the machine's own or a remote file system that pyarrow knows."""

from __future__ import annotations

import hashlib
import re

from pyarrow import NativeFile, fs

#: Bytes of a file in memory at a time.
BLOCK = 1 << 20


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path on it."""
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)


def open_file(path: str) -> NativeFile:
    files, at = file_system(path)
    return files.open_input_file(at)


def digest(path: str) -> str:
    """SHA-256 of a file of any size, read block by block."""
    files, at = file_system(path)
    sha = hashlib.sha256()
    with files.open_input_stream(at, compression=None) as f:
        while block := f.read(BLOCK):
            sha.update(block)
    return sha.hexdigest()
