"""Files of any store that pyarrow reaches, by path or URI, for tasks that read ranges or write files of their own."""

from __future__ import annotations

import re

from pyarrow import fs


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    path = re.sub(r"\Afile:/+", "file:///", path)
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def write_file(path: str, data: bytes) -> int:
    """Writes a file that has its name only once it is whole; returns its size."""
    files, at = store(path)
    folder, _, name = at.rpartition("/")
    files.create_dir(folder, recursive=True)
    temp = f"{folder}/.{name}.open"
    with files.open_output_stream(temp) as f:
        f.write(data)
    files.move(temp, at)
    return len(data)


def read_range(path: str, start: int, size: int) -> bytes:
    files, at = store(path)
    with files.open_input_file(at) as f:
        return f.read_at(size, start)
