"""Binary files in the shared scratch folder, written and read inside tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def place(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder's URI."""
    return fs.FileSystem.from_uri(folder)


def write_new(folder: str, stem: str, data: bytes) -> str:
    """Write a file under a name that no other attempt uses and return the name.

    A file counts only if the result of the task that wrote it names it, so a repeated or lost task leaves at
    most a file that nobody reads.
    """
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}"
    with system.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(data)
    return name


class Ranges:
    """Range reads that keep the last file open, for reads sorted by file."""

    def __init__(self, folder: str):
        self.system, self.path = place(folder)
        self.name, self.file = None, None

    def read(self, name: str, start: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.system.open_input_file(f"{self.path}/{name}")
        return self.file.read_at(length, start)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.name, self.file = None, None
