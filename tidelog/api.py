"""The engine's operations on local arrays, archives and directories, for callers without DataFrames of their own.

Each one runs the DataFrame operators in the active session, or in one that it starts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import codec
from tidelog.operators import align, archive, discovery, integrity, transfer
from tidelog.operators.archive import LEAST_SPLIT as PARALLEL_PROCESSING_THRESHOLD
from tidelog.operators.archive import discover_log_archives, find_log_archive
from tidelog.operators.arrays import SharedArray as SharedMemoryArray
from tidelog.operators.config import EXCLUDE as YAML_EXCLUDE_METADATA
from tidelog.operators.config import YamlConfig
from tidelog.operators.tracker import JobState, ProcessingTracker, resolve_status
from tidelog.operators.tracker import Label as TrackerStatus
from tidelog.operators.tracker import Status as ProcessingStatus
from tidelog.operators.transfer import delete_directory
from tidelog.runtime import initialize_worker_threads, limit_worker_threads
from tidelog.schema import PACKAGE
from tidelog.sources.npz import Wanted
from tidelog.streaming.ingest import DataLogger

#: Ends of the names of a log's directory and of an archive. Fixed values.
LOG_DIRECTORY_SUFFIX, LOG_ARCHIVE_SUFFIX = "_data_log", "_log.npz"

__all__ = [
    "LOG_ARCHIVE_SUFFIX", "LOG_DIRECTORY_SUFFIX", "PARALLEL_PROCESSING_THRESHOLD", "YAML_EXCLUDE_METADATA",
    "DataLogger", "JobState", "LogArchiveReader", "LogMessage", "LogPackage", "ProcessingStatus", "ProcessingTracker", "SharedMemoryArray", "TrackerStatus", "YamlConfig",
    "assemble_log_archives", "calculate_directory_checksum", "delete_directory", "discover_log_archives", "discover_marker_files",
    "discover_marker_roots", "find_log_archive", "initialize_worker_threads", "interpolate_data", "limit_worker_threads",
    "read_archive_message_count", "resolve_status", "resolve_unique_roots", "session", "transfer_directory", "walk_directory", "walk_files",
]


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


@dataclass(frozen=True)
class LogPackage:
    """One entry before it is stored. TypeError for a payload other than booleans or unsigned integers."""

    source_id: int
    acquisition_time: int
    serialized_data: np.ndarray

    @property
    def payload(self) -> bytes:
        if self.serialized_data.dtype.kind not in "bu":
            raise TypeError(f"a payload of {self.serialized_data.dtype} can't be stored as bytes")
        return self.serialized_data.astype(np.uint8).tobytes()

    @property
    def row(self) -> tuple:
        return int(self.source_id), Decimal(int(self.acquisition_time)), bytearray(self.payload)

    @property
    def data(self) -> tuple[str, np.ndarray]:
        """The name of the entry's file, and header and payload."""
        stored = bytes([int(self.source_id)]) + int(self.acquisition_time).to_bytes(8, "little") + self.payload
        return f"{int(self.source_id):03d}_{int(self.acquisition_time):020d}.npy", np.frombuffer(stored, np.uint8)


def packages(rows: Sequence[LogPackage]) -> DataFrame:
    return session().createDataFrame([p.row for p in rows], PACKAGE)


@dataclass(frozen=True)
class LogMessage:
    timestamp_us: int
    payload: np.ndarray


class LogArchiveReader:
    """The messages of one archive. ValueError on decoding if it has no onset entry and none is given."""

    def __init__(self, archive_path: str, onset_us: int | None = None) -> None:
        self.archive_path, self._given = str(archive_path), onset_us
        self.frame = archive.read_archive(session(), self.archive_path)

    def __repr__(self) -> str:
        return f"LogArchiveReader({self.archive_path!r})"

    @cached_property
    def _onset(self) -> tuple[int | None, int | None]:
        """The onset's place in the archive and its time, as far as they are there: the first entry at time 0; of an archive
        whose onset is given, the first with an onset's name."""
        if self._given is not None:
            named = self._names().filter(F.col("entry_key").endswith("_" + "0" * 20))
            return named.agg(F.min("place")).first()[0], self._given
        data = F.col("data")
        zero = archive.read_archive(session(), self.archive_path, Wanted(high=0))
        row = zero.agg(F.min_by(F.struct("place", codec.u64_value(codec.payload_of(data)).alias("onset")), "place").alias("first")).first()
        return (row["first"]["place"], int(row["first"]["onset"])) if row["first"] else (None, None)

    def _names(self) -> DataFrame:
        return archive.read_archive(session(), self.archive_path, names_only=True)

    @property
    def onset_timestamp_us(self) -> int:
        if self._onset[1] is None:
            raise ValueError(f"{self.archive_path} has no onset entry")
        return self._onset[1]

    def _after(self, rows: DataFrame) -> DataFrame:
        """What follows the onset; everything if the onset is given and has no entry of its own."""
        self.onset_timestamp_us  # noqa: B018  ValueError where there is none
        return rows if self._onset[0] is None else rows.filter(F.col("place") > self._onset[0])

    @property
    def message_count(self) -> int:
        return self._after(self._names()).count()

    @cached_property
    def keys(self) -> list[str]:
        return [r["entry_key"] for r in self._after(self._names()).select("entry_key", "place").orderBy("place").collect()]

    def get_batches(self, workers: int = -1, batch_multiplier: int = archive.BATCHES_PER_WORKER) -> list[list[str]]:
        """The keys in runs: one run below LEAST_SPLIT keys, none without keys."""
        keys, n = self.keys, len(self.keys)
        if n < archive.LEAST_SPLIT:
            return [keys] if keys else []
        workers = workers if workers > 0 else session().sparkContext.defaultParallelism
        size = max(1, -(-n // (workers * max(1, batch_multiplier))))
        return [keys[k : k + size] for k in range(0, n, size)]

    def messages(self, keys: Sequence[str] | None = None) -> DataFrame:
        """(place, timestamp_us, payload) of all messages, or of some keys in the order given."""
        data = F.col("data")
        if keys is None:
            rows = self._after(self.frame)
        else:
            wanted = session().createDataFrame(list(enumerate(keys)), "place long, entry_key string")
            own = archive.read_archive(session(), self.archive_path, Wanted(keys=frozenset(keys)))
            rows = own.drop("place").join(wanted, "entry_key")
        return rows.select("place", (codec.elapsed_of(data) + F.lit(Decimal(self.onset_timestamp_us))).cast("decimal(20,0)").alias("timestamp_us"), codec.payload_of(data).alias("payload"))

    def iter_messages(self, keys: Sequence[str] | None = None) -> Iterator[LogMessage]:
        for row in self.messages(keys).orderBy("place").toLocalIterator():
            yield LogMessage(int(row["timestamp_us"]), np.frombuffer(bytes(row["payload"]), np.uint8))

    def read_all_messages(self) -> tuple[np.ndarray, list[np.ndarray]]:
        rows = list(self.iter_messages())
        return np.array([m.timestamp_us for m in rows], np.uint64), [m.payload for m in rows]


def read_archive_message_count(archive_path: str) -> int:
    return archive.archive_message_count(session(), str(archive_path))


def assemble_log_archives(log_directory: str, max_workers: int | None = None, *, remove_sources: bool = True, memory_mapping: bool = True, verbose: bool = False, verify_integrity: bool = False) -> list[str]:
    """max_workers bounds the tasks that write archives. Entries are streamed, so memory_mapping has nothing to change;
    verbose is the session's own progress display."""
    return archive.assemble_log_archives(session(), str(log_directory), remove_sources=remove_sources, verify_integrity=verify_integrity, tasks=max_workers)


#: Coordinates of a series that one task aligns.
SERIES = 100_000


def interpolate_data(source_coordinates: np.ndarray, source_values: np.ndarray, target_coordinates: np.ndarray, *, is_discrete: bool) -> np.ndarray:
    """One series of arrays, in order of the targets: the source's type when discrete, else float64."""
    if not len(source_coordinates) or not len(source_values):
        raise ValueError("the source series is empty")
    spark = session()
    source = spark.createDataFrame([(0, float(x), v, i) for i, (x, v) in enumerate(zip(source_coordinates.tolist(), source_values.tolist(), strict=True))], "k int, x double, v " + ("double" if source_values.dtype.kind == "f" else "boolean" if source_values.dtype.kind == "b" else "long") + ", i long")
    targets = spark.createDataFrame([(0, float(x), i) for i, x in enumerate(np.asarray(target_coordinates).tolist())], "k int, x double, n long")
    # A long series is cut into buckets of about SERIES coordinates.
    reach = float(np.ptp(source_coordinates.astype(float))) if len(source_coordinates) > SERIES else 0.0
    bucket = reach * SERIES / len(source_coordinates) or None
    rows = align.interpolate(source, targets, key="k", discrete=is_discrete, order="i", check=False, bucket=bucket).orderBy("n").collect()
    return np.array([r["v"] for r in rows], source_values.dtype if is_discrete else np.float64)


def calculate_directory_checksum(directory: str, num_processes: int | None = None, *, progress: bool = False, save_checksum: bool = True, excluded_files: set[str] | None = None) -> str:
    """Spark's own tasks hash the files: num_processes and progress are taken for callers of that signature and change nothing."""
    return integrity.directory_checksum(session(), str(directory), save=save_checksum, excluded=excluded_files)


def transfer_directory(source: str, destination: str, num_threads: int = 1, *, verify_integrity: bool = False, remove_source: bool = False, progress: bool = False, reset_dirty_destination: bool = False) -> None:
    """num_threads and progress are taken as in calculate_directory_checksum()."""
    transfer.transfer_directory(session(), str(source), str(destination), verify_integrity=verify_integrity, remove_source=remove_source, reset_dirty_destination=reset_dirty_destination)


def walk_directory(directory: str) -> list[str]:
    return [r["path"] for r in discovery.walk_directory(session(), str(directory)).select("path").collect()]


def walk_files(directory: str) -> list[str]:
    return [r["path"] for r in discovery.walk_files(session(), str(directory)).select("path").collect()]


def discover_marker_files(directory: str, marker_name: str) -> list[str]:
    return [r["path"] for r in discovery.marker_files(discovery.walk_directory(session(), str(directory)), marker_name).collect()]


def discover_marker_roots(directory: str, marker_name: str, levels_up: int = 0) -> list[str]:
    markers = discovery.marker_files(discovery.walk_directory(session(), str(directory)), marker_name)
    return [r["root"] for r in discovery.marker_roots(markers, levels_up).collect()]


def resolve_unique_roots(paths: Sequence[str]) -> tuple[str, ...]:
    """ValueError if some path has no part of its own."""
    rows = session().createDataFrame([(k, str(p)) for k, p in enumerate(paths)], "ord long, path string")
    try:
        return tuple(r["root"] for r in discovery.unique_roots(rows).orderBy("ord").collect())
    except Exception as error:
        if "part of its own" in str(error):
            raise ValueError("a path has no part of its own") from error
        raise
