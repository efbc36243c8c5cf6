"""Binary files in the shared folder, by URI, from driver or executors."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else uri.replace("file:", "file://", 1))


class Output:
    """A new file below a folder, named uniquely: a repeated task attempt never writes to another's file.

    Readers find files by the index that the finished tasks return, so files of lost attempts are never read.
    """

    def __init__(self, folder: str, suffix: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
        filesystem, path = _open(self.uri)
        filesystem.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream = filesystem.open_output_stream(path, compression=None)
        self.offset = 0

    def write(self, data: bytes) -> int:
        """Append; returns the offset of the first byte."""
        at = self.offset
        self.stream.write(data)
        self.offset += len(data)
        return at

    def close(self) -> None:
        self.stream.close()


class Input:
    """Random access to one file."""

    def __init__(self, uri: str):
        filesystem, path = _open(uri)
        self.file = filesystem.open_input_file(path)

    def read(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)

    def close(self) -> None:
        self.file.close()
