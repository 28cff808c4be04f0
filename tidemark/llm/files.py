"""Files that tasks write to the shared folder and read back, by any store that Arrow knows."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs


def create(folder: str, name: str) -> tuple[str, pa.NativeFile]:
    """A new file below ``folder``: its address and a stream to write it.

    The address is unique, so a repeated attempt of a task never touches the file of another one.
    Only addresses that the finished attempt has put into its result are read later.
    """
    address = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    store, path = fs.FileSystem.from_uri(address)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return address, store.open_output_stream(path, compression=None)


def open_stream(address: str) -> pa.NativeFile:
    store, path = fs.FileSystem.from_uri(address)
    return store.open_input_stream(path, compression=None)


def open_random(address: str) -> pa.NativeFile:
    store, path = fs.FileSystem.from_uri(address)
    return store.open_input_file(path)
