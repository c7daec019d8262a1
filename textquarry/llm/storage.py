"""Files that tasks write and read themselves, on any file system Arrow knows."""

from __future__ import annotations

import re

import numpy as np


def filesystem(uri: str):
    """(file system, path in it) of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write_bytes(uri: str, *blobs) -> None:
    system, path = filesystem(uri)
    with system.open_output_stream(path, compression=None) as out:
        for blob in blobs:
            out.write(blob)


def mapped(uri: str, dtype: str) -> np.ndarray:
    """A flat file as an array: memory-mapped where the file is local, else read whole."""
    from pyarrow import fs

    system, path = filesystem(uri)
    info = system.get_file_info(path)
    if not info.size:
        return np.empty(0, dtype=dtype)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with system.open_input_file(path) as source:
        return np.frombuffer(source.read(), dtype=dtype)
