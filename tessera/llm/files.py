"""Files of our own formats in the shared folder, reached from executors by URI (file, hdfs, s3, gs)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it. A bare path is local."""
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


class Writer:
    """A new file in a folder. Its name is of this attempt alone: what a lost task left is in no index and harms nothing."""

    def __init__(self, folder: str, suffix: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
        self.fs, path = resolve(self.uri)
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(path, compression=None)
        self.at = 0

    def write(self, data: bytes) -> int:
        """The offset at which data begins."""
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at

    def close(self) -> None:
        self.out.close()


class Reader:
    """Byte ranges of files; keeps the last file open."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            self.close()
            file_system, path = resolve(uri)
            self.uri, self.file = uri, file_system.open_input_file(path)
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.uri, self.file = None, None
