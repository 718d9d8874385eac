"""format("treelist"): all entries below a directory, hidden ones too; links are reported and not followed."""

from __future__ import annotations

import errno
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tidelog.schema import TREE

#: Errors that say that what a link points to is not there.
ABSENT = {errno.ENOENT, errno.ENOTDIR, errno.EBADF, errno.ELOOP}


def kind_of(entry: os.DirEntry) -> str:
    """file or dir, through a link if it is one; else link. Errors other than of absence go up."""
    try:
        if entry.is_file():
            return "file"
        if entry.is_dir():
            return "dir"
        os.stat(entry.path)
    except OSError as error:
        if error.errno not in ABSENT:
            raise
    return "link" if entry.is_symlink() else "other"


def walk(top: str, start: str | None = None) -> Iterator[tuple]:
    """Rows of all that is below `start`, with paths relative to `top`. A directory that can't be read is an error."""
    stack = [start or top]
    while stack:
        with os.scandir(stack.pop()) as entries:
            for entry in entries:
                yield row(top, entry)
                if entry.is_dir(follow_symlinks=False):
                    stack.append(entry.path)


def row(top: str, entry: os.DirEntry) -> tuple:
    rel = os.path.relpath(entry.path, top)
    kind = kind_of(entry)
    return entry.path, rel, entry.name, rel.count(os.sep) + 1, kind, entry.is_symlink(), entry.stat().st_size if kind == "file" else None


class Branch(InputPartition):
    def __init__(self, path: str | None) -> None:
        self.path = path


class TreeReader(DataSourceReader):
    def __init__(self, top: str) -> None:
        self.top = top

    def partitions(self) -> list[Branch]:
        """The directory itself, and each directory in it."""
        with os.scandir(self.top) as entries:
            return [Branch(None), *(Branch(e.path) for e in entries if e.is_dir(follow_symlinks=False))]

    def read(self, partition: Branch) -> Iterator[tuple]:
        if partition.path is not None:
            yield from walk(self.top, partition.path)
            return
        with os.scandir(self.top) as entries:
            for entry in entries:
                yield row(self.top, entry)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "treelist"

    def schema(self) -> StructType:
        return TREE

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(os.path.abspath(self.options["path"]))
