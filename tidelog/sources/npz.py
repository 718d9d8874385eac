"""Entry files (one NumPy array each) and archives (an uncompressed zip of arrays for each source): scans and sinks.

The name of an entry is its key: source and time, as `{source:03d}_{time:020d}`. What a scan is for (Wanted) is looked up in
the names, so that files and members which can't be wanted are not opened. A member with another name is read, and its
source and time are those of its first nine bytes. Sinks write to a staging folder, and what they wrote appears at the commit.
"""

from __future__ import annotations

import functools
import io
import json
import os
import re
import shutil
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from decimal import Decimal
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StructType

from tidelog.schema import WIRE

#: Entry files that one task reads, and bytes of an archive.
PART, SPLIT = 4096, 64 << 20
HEADER_BYTES = 9
#: Members that are read at a time where all of an archive are, and bytes of an array's header and of a zip's before a member.
TOGETHER, ARRAY_HEAD, LOCAL_HEAD = 4096, 10, 30
NAME = re.compile(r"(\d{3})_(\d{20})")


@dataclass(frozen=True)
class Wanted:
    """Which entries a scan is for: sources, times from `low` to `high`, keys; None is all. Given when the scan is made.

    It is not taken from the filters of a query (`pushFilters`): Spark 4.1 keeps the filters it pushed into a Python source
    with the loaded DataFrame, so that the next query over the same DataFrame would miss what the last one did not ask for.
    """

    sources: frozenset[int] | None = None
    low: int = 0
    high: int = 2**64 - 1
    keys: frozenset[str] | None = None

    def option(self) -> str:
        return json.dumps([None if self.sources is None else sorted(self.sources), self.low, self.high, None if self.keys is None else sorted(self.keys)])

    @classmethod
    def of(cls, options: dict[str, str]) -> Wanted:
        if "wanted" not in options:
            return cls()
        sources, low, high, keys = json.loads(options["wanted"])
        return cls(None if sources is None else frozenset(sources), low, high, None if keys is None else frozenset(keys))

    def name(self, stem: str) -> bool:
        """Whether the entry of this name may be wanted; a name of another form says nothing of source and time."""
        if self.keys is not None and stem not in self.keys:
            return False
        form = NAME.fullmatch(stem)
        return form is None or self.holds(int(form[1]), int(form[2]))

    def holds(self, source: int, time: int) -> bool:
        return self.low <= time <= self.high and (self.sources is None or source in self.sources)


def _entry(stem: str, raw: bytes) -> bytes:
    if len(raw) < HEADER_BYTES:
        raise ValueError(f"the entry {stem} has no header")
    return raw


def row(stem: str, data: np.ndarray) -> tuple:
    """An entry as stored. ValueError if it is too short for its source and time."""
    raw = _entry(stem, data.tobytes())
    return raw[0], Decimal(int.from_bytes(raw[1:HEADER_BYTES], "little")), stem, raw


@functools.lru_cache(4096)
def _array_head(size: int) -> bytes:
    """What an array of so many bytes begins with."""
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": "|u1", "fortran_order": False, "shape": (size,)})
    return out.getvalue()


@functools.lru_cache(4096)
def _array_size(head: bytes) -> int | None:
    """Bytes of the values after a header of version 1; None if they are not as they lie there."""
    shape, fortran, dtype = np.lib.format.read_array_header_1_0(io.BytesIO(head[8:]))
    return None if dtype.hasobject or (fortran and len(shape) > 1) else prod(shape) * dtype.itemsize


def array_bytes(raw: bytes) -> bytes:
    """The values of an array as a file has it. ValueError as by NumPy."""
    if raw[:8] == b"\x93NUMPY\x01\x00":
        start = ARRAY_HEAD + int.from_bytes(raw[8:ARRAY_HEAD], "little")
        size = _array_size(raw[:start])
        if size is not None and len(raw) - start >= size:
            return raw[start : start + size]
    return np.lib.format.read_array(io.BytesIO(raw), allow_pickle=False).tobytes()


@dataclass
class Files(InputPartition):
    names: list[str]


class EntryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.wanted = options["path"], Wanted.of(options)

    def partitions(self) -> list[Files]:
        with os.scandir(self.path) as found:
            names = sorted(e.name for e in found if e.name.endswith(".npy") and self.wanted.name(e.name[:-4]) and e.is_file())
        return [Files(names[k : k + PART]) for k in range(0, len(names), PART)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for name in partition.names:
            entry = row(name[:-4], np.load(os.path.join(self.path, name), allow_pickle=False))
            if self.wanted.holds(entry[0], int(entry[1])):
                yield entry


@dataclass
class Span(InputPartition):
    """The members of an archive whose place in the file is from `low` to before `high`."""

    path: str
    low: int
    high: int


class MemberReader(DataSourceReader):
    """Archives are split by bytes, so the driver reads no directory of an archive."""

    def __init__(self, options: dict[str, str]) -> None:
        self.wanted = Wanted.of(options)
        self.archives = json.loads(options["archives"]) if "archives" in options else [options["path"]]
        self.only = options.get("names_only", "false").lower() == "true"
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[Span]:
        sizes = [(path, os.path.getsize(path)) for path in self.archives]
        return [Span(path, low, low + self.split) for path, size in sizes for low in range(0, max(size, 1), self.split)] or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        if not partition.path:
            return
        with zipfile.ZipFile(partition.path) as archive:
            if self.wanted == Wanted() and not self.only:
                yield from self._whole(archive, [(place, m) for place, m in enumerate(archive.infolist()) if partition.low <= m.header_offset < partition.high])
                return
            for place, member in enumerate(archive.infolist()):
                stem = member.filename.removesuffix(".npy")
                if not partition.low <= member.header_offset < partition.high or not self.wanted.name(stem):
                    continue
                if self.only:
                    form = NAME.fullmatch(stem)
                    yield (*((int(form[1]), Decimal(form[2])) if form else (None, None)), stem, None, place)
                    continue
                with archive.open(member) as file:
                    entry = row(stem, np.lib.format.read_array(file, allow_pickle=False))
                if self.wanted.holds(entry[0], int(entry[1])):
                    yield *entry, place


    def _whole(self, archive: zipfile.ZipFile, members: list[tuple[int, zipfile.ZipInfo]]) -> Iterator[pa.RecordBatch]:
        """Members of which none is left out, many at a time; those that are not compressed are read as they lie in the file."""
        with open(archive.filename, "rb") as file:
            for k in range(0, len(members), TOGETHER):
                some = members[k : k + TOGETHER]
                data = [_entry(m.filename.removesuffix(".npy"), array_bytes(_stored(file, archive, m))) for _, m in some]
                times = pa.array([int.from_bytes(d[1:HEADER_BYTES], "little") for d in data], pa.uint64()).cast(pa.decimal128(20, 0))
                stems = [m.filename.removesuffix(".npy") for _, m in some]
                columns = [pa.array([d[0] for d in data], pa.int32()), times, pa.array(stems, pa.string()), pa.array(data, pa.binary()), pa.array([place for place, _ in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*WIRE.names, "place"])


def _stored(file: io.BufferedReader, archive: zipfile.ZipFile, member: zipfile.ZipInfo) -> bytes:
    """What a member holds. BadZipFile if it is not what was written."""
    if member.compress_type == zipfile.ZIP_STORED and not member.flag_bits & 1:
        file.seek(member.header_offset)
        head = file.read(LOCAL_HEAD)
        file.seek(int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"), os.SEEK_CUR)
        raw = file.read(member.file_size)
        if head[:4] == b"PK\x03\x04" and len(raw) == member.file_size and zlib.crc32(raw) == member.CRC:
            return raw
    with archive.open(member) as other:
        return other.read()


# --- Sinks ---


@dataclass
class Staged(WriterCommitMessage):
    """What one attempt of a task has written: its folder, and the names there."""

    folder: str
    names: list[str]


class EntryWriter(DataSourceWriter):
    """An entry file for each row. Every attempt writes to a folder of its own below the staging folder of this write.

    The commit moves the files of the attempts that count, and removes the staging folder with what other attempts left;
    an abort removes it alone. An entry replaces one of its name.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.staging = os.path.join(self.path, f".staging-{uuid.uuid4().hex}")

    def attempt(self) -> str:
        folder = os.path.join(self.staging, uuid.uuid4().hex)
        os.makedirs(folder)
        return folder

    def write(self, iterator: Iterator[Row]) -> Staged:
        folder, names = self.attempt(), []
        for entry in iterator:
            save_entry(folder, entry.entry_key, entry.data)
            names.append(f"{entry.entry_key}.npy")
        return Staged(folder, names)

    def commit(self, messages: list[Staged | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        moves = [(os.path.join(m.folder, name), os.path.join(self.path, name)) for m in messages if m for name in m.names]
        with ThreadPoolExecutor() as pool:
            list(pool.map(lambda move: os.replace(*move), moves, chunksize=256))
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class ArchiveWriter(EntryWriter):
    """One archive for each source. Rows must come in order of source and time, and a source must be in one task.

    ValueError, before anything appears, if a source is in several tasks or comes again in one. An archive replaces the
    source's former one. A source is streamed to its archive and need not fit in memory.
    """

    def write(self, iterator: Iterator[Row]) -> Staged:
        folder, names, now, archive = self.attempt(), [], None, None
        try:
            for entry in iterator:
                if entry.source_id != now:
                    if archive is not None:
                        archive.close()
                    now = entry.source_id
                    names.append(f"{now}_log.npz")
                    archive = zipfile.ZipFile(os.path.join(folder, names[-1]), "x", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(f"{entry.entry_key}.npy"), _array_head(len(entry.data)) + entry.data)
        except FileExistsError:
            raise ValueError(f"the entries of source {now} are not in order of source") from None
        finally:
            if archive is not None:
                archive.close()
        return Staged(folder, names)

    def commit(self, messages: list[Staged | None]) -> None:
        names = [name for m in messages if m for name in m.names]
        if again := sorted({name for name in names if names.count(name) > 1}):
            self.abort(messages)
            raise ValueError(f"several tasks have entries of the archives {again}")
        super().commit(messages)


class EntryStreamWriter(DataSourceStreamWriter):
    """Entry files of each batch of a stream. A batch that runs again writes the same names again."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.inner = EntryWriter(options)

    def write(self, iterator: Iterator[Row]) -> Staged:
        return self.inner.write(iterator)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self.inner.commit(messages)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self.inner.abort(messages)


class EntrySource(DataSource):
    """format("npylog"): the entry files of one directory, to read, and to write by batch or stream (rows as WIRE).

    The option `wanted` is that of Wanted.
    """

    @classmethod
    def name(cls) -> str:
        return "npylog"

    def schema(self) -> StructType:
        return WIRE

    def reader(self, schema: StructType) -> DataSourceReader:
        return EntryReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return EntryWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return EntryStreamWriter(self.options)


class MemberSource(EntrySource):
    """format("npzlog"): the members of one archive, or of those in the option `archives`, a JSON list, with their place in it.

    `names_only` reads no data; source and time are then null for names of another form. `split` is the size of a part in
    bytes. Writing makes an archive for each source in a directory.
    """

    @classmethod
    def name(cls) -> str:
        return "npzlog"

    def schema(self) -> StructType:
        return StructType([*WIRE.fields]).add("place", LongType())

    def reader(self, schema: StructType) -> DataSourceReader:
        return MemberReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        raise ValueError("archives are not written by streams; consolidate entry files")


def save_entry(directory: str, key: str, data: bytes) -> None:
    np.save(os.path.join(directory, f"{key}.npy"), np.frombuffer(data, np.uint8), allow_pickle=False)
