"""An inbox that any number of producers fill at once, and a stream over it.

Each producer has a folder of its own with numbered files, so producers never wait for each other. The stream's offset is
the next number of each producer; Spark's checkpoint keeps it, so each entry is taken in once, over restarts too.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidelog.runtime import ship
from tidelog.schema import PACKAGE

SCHEMA = pa.schema([("source_id", pa.int32()), ("acquisition_time", pa.decimal128(20, 0)), ("serialized_data", pa.binary())])
#: Files that one task reads, and bytes of a file that put_all() makes.
TOGETHER, FILE = 64, 16 << 20


def _file(folder: str, number: int) -> str:
    return os.path.join(folder, f"{number:020d}.arrow")


class Producer:
    """Puts packages into an inbox under a name that no other producer has at that time; a later one of that name goes on after it.

    put() returns when its packages are there as a whole. The rows are (source_id, acquisition_time, payload bytes).
    """

    def __init__(self, inbox: str, name: str) -> None:
        if not name or name.startswith((".", "_")) or os.sep in name:
            raise ValueError(f"{name!r} can't be the name of a producer")
        self.folder = os.path.join(inbox, name)
        os.makedirs(self.folder, exist_ok=True)
        with os.scandir(self.folder) as found:
            self.next = max((int(e.name[:20]) + 1 for e in found if e.name.endswith(".arrow") and e.name[:20].isdigit()), default=0)

    def put(self, rows: Sequence[tuple]) -> None:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(SCHEMA)
        arrays = [pa.array(list(columns[0]), pa.int32()), pa.array(list(map(int, columns[1])), pa.uint64()).cast(pa.decimal128(20, 0)), pa.array(list(map(bytes, columns[2])), pa.binary())]
        self._write([pa.RecordBatch.from_arrays(arrays, schema=SCHEMA)])

    def put_all(self, batches: Iterable[pa.RecordBatch], file_bytes: int = FILE) -> None:
        """Put Arrow batches (of the columns of PACKAGE) in files of about so many bytes, or of one batch: a stream pays for each file it takes in."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch.cast(SCHEMA))
            if sum(b.nbytes for b in held) >= file_bytes:
                self._write(held)
                held = []
        if held:
            self._write(held)

    def _write(self, batches: list[pa.RecordBatch]) -> None:
        part = os.path.join(self.folder, f".{uuid.uuid4().hex}")
        with pa.ipc.new_file(part, SCHEMA) as file:
            for batch in batches:
                file.write_batch(batch)
        os.link(part, _file(self.folder, self.next))  # an error, and no overwriting, if another producer has this name
        os.unlink(part)
        self.next += 1


@dataclass
class Taken(InputPartition):
    paths: list[str]


class InboxReader(DataSourceStreamReader):
    """`limit` is the number of files that a batch takes at most, dealt to the producers in turn; `clean` removes files that
    no later batch of this query needs.

    Spark does not say where a restarted query stands, so with either of them the end of the last planned batch is also kept
    in the inbox, under the reader's name. It is written when a batch is planned, which a restart does again for a batch that
    Spark had begun, so it never differs from what Spark has logged.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.inbox, self.limit = options["path"], int(options.get("maxfilespertrigger", 0))
        self.clean = options.get("clean", "false").lower() == "true"
        self.state = os.path.join(self.inbox, f"_{options.get('reader', 'reader')}.json")
        self.planned: dict[str, int] | None = None

    def initialOffset(self) -> dict[str, int]:
        self._plan({})
        return {}

    def _plan(self, end: dict[str, int]) -> None:
        self.planned = end
        if self.limit or self.clean:
            part = f"{self.state}.{uuid.uuid4().hex}"
            with open(part, "w") as file:
                json.dump(end, file)
            os.replace(part, self.state)

    def latestOffset(self) -> dict[str, int]:
        if self.planned is None and (self.limit or self.clean) and os.path.exists(self.state):
            with open(self.state) as file:
                self.planned = json.load(file)
        end = dict(self.planned or {})
        with os.scandir(self.inbox) as found:
            waiting = {e.name: end.get(e.name, 0) for e in sorted(found, key=lambda e: e.name) if e.is_dir() and not e.name.startswith((".", "_"))}
        left = self.limit or float("inf")
        while waiting and left > 0:
            # In turns of one file with a limit; else all of a producer's at once.
            for name in list(waiting):
                number = waiting[name]
                while os.path.exists(_file(os.path.join(self.inbox, name), number)) and left > 0:
                    number, left = number + 1, left - 1
                    if self.limit:
                        break
                if number == waiting[name] or not self.limit:
                    del waiting[name]
                else:
                    waiting[name] = number
                if number:
                    end[name] = number
        return end

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Taken]:
        self._plan(end)
        paths = [_file(os.path.join(self.inbox, name), k) for name in sorted(end) for k in range(start.get(name, 0), end[name])]
        return [Taken(paths[k : k + TOGETHER]) for k in range(0, len(paths), TOGETHER)]

    def read(self, partition: Taken) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            with pa.OSFile(path) as file:
                yield from pa.ipc.open_file(file).read_all().to_batches()

    def commit(self, end: dict[str, int]) -> None:
        """The last file of a producer stays, so that it keeps counting."""
        if not self.clean:
            return
        for name, number in end.items():
            k = number - 2
            while k >= 0 and os.path.exists(path := _file(os.path.join(self.inbox, name), k)):
                os.unlink(path)
                k -= 1


class InboxSource(DataSource):
    """format("inbox"): what producers put into a directory. Options: maxFilesPerTrigger, reader (a name for each query over one inbox), clean."""

    @classmethod
    def name(cls) -> str:
        return "inbox"

    def schema(self) -> StructType:
        return PACKAGE

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return InboxReader(self.options)


def producer_stream(spark: SparkSession, inbox: str, *, files_per_trigger: int = 0, reader: str = "reader", clean: bool = False) -> DataFrame:
    """The packages that producers put into an inbox, as they come."""
    ship(spark)
    spark.dataSource.register(InboxSource)
    os.makedirs(inbox, exist_ok=True)
    return spark.readStream.format("inbox").option("maxFilesPerTrigger", files_per_trigger).option("reader", reader).option("clean", clean).load(inbox)
