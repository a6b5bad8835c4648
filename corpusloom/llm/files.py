"""Binary files in the shared folder, written and read by tasks.

Spark has no binary sink, so tasks write through ``pyarrow.fs``, which opens the same addresses (file, hdfs, s3, gs). A task
writes under a name of its own and renames at the end: a repeated or speculative attempt replaces a file by an equal one, and
a reader never sees half a file.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{uri}"
    return fs.FileSystem.from_uri(uri)


@contextmanager
def writing(uri: str):
    """A new file that is there as a whole or not at all."""
    system, path = place(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part, compression=None) as out:
        yield out
    system.move(part, path)


@contextmanager
def reading(uri: str):
    """A file with random access."""
    system, path = place(uri)
    with system.open_input_file(path) as f:
        yield f


def size(uri: str) -> int:
    system, path = place(uri)
    return system.get_file_info(path).size
