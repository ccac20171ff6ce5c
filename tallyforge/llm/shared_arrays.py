"""Arrays in files of the shared folder, written and read by executors.

Files are written under a name of their own and then renamed, so a task that runs twice leaves one whole file.  On a
local or mounted file system they are memory-mapped; from any other store that pyarrow reads they are fetched into a
local file that is unlinked as soon as it is mapped.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _local(uri: str) -> str | None:
    path = uri.removeprefix("file://") if uri.startswith("file://") else uri.removeprefix("file:")
    return path if path.startswith("/") else None


def write_array(uri: str, array: np.ndarray) -> None:
    """Writes the array's bytes to ``uri``; the element type is the reader's to know."""
    store, path = _store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(np.ascontiguousarray(array).view(np.uint8).data if array.size else b"")
    store.move(draft, path)


class ArrayFile:
    """A file of the shared folder that a task writes bit by bit; it gets its name when it is closed."""

    def __init__(self, uri: str):
        self.store, self.path = _store(uri)
        self.store.create_dir(os.path.dirname(self.path), recursive=True)
        self.draft = f"{self.path}.{uuid.uuid4().hex}"
        self.out, self.size = self.store.open_output_stream(self.draft), 0

    def append(self, *arrays: np.ndarray) -> int:
        """Writes the arrays one after the other, each from a multiple of 8 bytes on; where the first begins."""
        begin = self.size
        for array in arrays:
            data = np.ascontiguousarray(array).view(np.uint8)
            self.out.write(data.data if array.size else b"")
            pad = -len(data) % 8 if array.size else 0
            self.out.write(bytes(pad))
            self.size += (len(data) if array.size else 0) + pad
        return begin

    def close(self) -> None:
        self.out.close()
        self.store.move(self.draft, self.path)


def map_array(uri: str, dtype) -> np.ndarray:
    """The array at ``uri``, memory-mapped."""
    path = _local(uri)
    if path is not None:
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    store, where = _store(uri)
    with tempfile.NamedTemporaryFile() as local, store.open_input_stream(where) as source:
        while piece := source.read(8 << 20):
            local.write(piece)
        local.flush()
        return np.memmap(local.name, dtype, "r") if local.tell() else np.empty(0, dtype)
