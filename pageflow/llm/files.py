"""Files that tasks write in the shared folder, by pyarrow's file systems."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, parts: Iterable[bytes]) -> int:
    """Write under another name and move, so that a task that is run again or twice leaves one whole file. Bytes written."""
    system, path = located(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    own, n = f"{path}.{uuid.uuid4().hex}", 0
    with system.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
            n += len(part)
    system.move(own, path)
    return n


def file_size(uri: str) -> int:
    system, path = located(uri)
    return system.get_file_info(path).size


def read_range(uri: str, start: int, length: int) -> bytes:
    system, path = located(uri)
    with system.open_input_file(path) as f:
        f.seek(start)
        return f.read(length)
