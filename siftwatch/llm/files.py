"""Binary files in the shared folder, written and read by tasks.

Spark has no writer for raw bytes, so tasks open files through ``pyarrow.fs`` (local paths, ``file:``, ``hdfs:``,
``s3:`` and ``gs:`` URIs). A file is written under a name of its attempt and moved into place when complete: a lost
or repeated attempt leaves the finished file as it is, since every attempt of a task writes the same bytes.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyarrow import fs
from pyspark import TaskContext

BLOCK = 4 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def exists(path: str) -> bool:
    store, place = opened(path)
    return store.get_file_info(place).type != fs.FileType.NotFound


@contextmanager
def writing(path: str):
    """A stream whose bytes appear under ``path`` only once the block ends without an error."""
    store, place = opened(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    task = TaskContext.get()
    attempt = f"{place}.attempt-{task.taskAttemptId() if task else 0}"
    with store.open_output_stream(attempt) as out:
        yield out
    store.move(attempt, place)


@contextmanager
def reading(path: str):
    store, place = opened(path)
    with store.open_input_file(place) as file:
        yield file


class Ranges:
    """Byte ranges of files. Ascending ranges of one file come out of one buffer of ``BLOCK`` bytes."""

    def __init__(self):
        self.path, self.file, self.start, self.held = None, None, 0, b""

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            self.close()
            store, place = opened(path)
            self.path, self.file, self.start, self.held = path, store.open_input_file(place), 0, b""
        at = offset - self.start
        if at < 0 or at + length > len(self.held):
            self.file.seek(offset)
            self.start, self.held, at = offset, self.file.read(max(length, BLOCK)), 0
        got = self.held[at : at + length]
        if len(got) < length:
            raise ValueError(f"{path} ends within a record at {offset}")
        return got

    def close(self):
        if self.file is not None:
            self.file.close()
        self.path = self.file = None
