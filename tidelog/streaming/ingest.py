"""Continuous ingestion of packages: a streaming query with a drain-then-stop contract."""

from __future__ import annotations

import os
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidelog.functions.codec import with_wire
from tidelog.schema import PACKAGE, WIRE
from tidelog.sources import register
from tidelog.streaming import compact
from tidelog.streaming.producers import Producer, producer_stream


def package_stream(spark: SparkSession, inbox: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """Packages that producers drop as Parquet files into a directory."""
    return spark.readStream.schema(PACKAGE).option("maxFilesPerTrigger", files_per_trigger).parquet(inbox)


def entry_stream(spark: SparkSession, log_directory: str) -> DataFrame:
    """The entry files of a directory as they come, as raw bytes with their path."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.npy").load(log_directory)


def _wire(packages: DataFrame) -> DataFrame:
    return with_wire(packages).select(*WIRE.names)


class _Watch(StreamingQueryListener):
    """What becomes of one run of a query: its last whole batch, and why it ended."""

    def __init__(self) -> None:
        self.run, self.batch, self.failure = "", -1, None

    def onQueryStarted(self, event) -> None:  # noqa: ANN001
        pass

    def onQueryIdle(self, event) -> None:  # noqa: ANN001
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001
        self.saw(event.progress)

    def saw(self, progress) -> None:  # noqa: ANN001
        """Triggers without data also have progress."""
        if progress is not None and str(progress.runId) == self.run and progress.numInputRows:
            self.batch = max(self.batch, progress.batchId)

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001
        if str(event.runId) == self.run and event.exception:
            self.failure = event.exception


class DataLogger:
    """Writes packages to `{name}_data_log`: Parquet by source, or one entry file each.

    They come from put(), from producers of any process that fill `inbox`, or from another stream given to start(). start()
    and stop() may be called again. Once a write has failed, put() and check() raise ChildProcessError, which names the
    batch. stop() first lets the query take in all that was there when it was called, then warns if a write had failed.
    """

    def __init__(self, output_directory: str, instance_name: str, *, thread_count: int = 5, poll_interval: int = 5, entry_files: bool = False) -> None:
        self.output_directory = os.path.join(output_directory, f"{instance_name}_data_log")
        self.name = instance_name
        self.thread_count, self.poll_interval = max(1, thread_count), max(0, poll_interval)
        self.entry_files = entry_files
        self.query: StreamingQuery | None = None
        self._watch = _Watch()
        self._producer: Producer | None = None
        os.makedirs(self.output_directory, exist_ok=True)

    @property
    def checkpoint(self) -> str:
        return os.path.join(os.path.dirname(self.output_directory), f".{self.name}_checkpoint")

    @property
    def inbox(self) -> str:
        return os.path.join(os.path.dirname(self.output_directory), f".{self.name}_inbox")

    def put(self, *packages: tuple) -> None:
        """Hand over packages (source_id, acquisition_time, payload bytes)."""
        self.check()
        if self._producer is None:
            self._producer = Producer(self.inbox, f"{os.getpid()}-{uuid.uuid4().hex}")
        self._producer.put(packages)

    @property
    def alive(self) -> bool:
        return self.query is not None and self.query.isActive

    def start(self, stream: DataFrame | None = None) -> None:
        if self.alive:
            return
        if stream is None:
            stream = producer_stream(SparkSession.active(), self.inbox)
        directory, threads = self.output_directory, self.thread_count

        def write(batch: DataFrame, batch_id: int) -> None:
            # A batch that runs again after a failure writes its own folder again.
            _wire(batch).repartition(threads, "source_id").write.mode("overwrite").parquet(os.path.join(directory, f"batch={batch_id}"))

        if self.entry_files:
            register(stream.sparkSession)
            writer = _wire(stream).repartition(threads).writeStream.format("npylog").option("path", directory)
        else:
            writer = stream.writeStream.foreachBatch(write)
        self._watch = _Watch()
        stream.sparkSession.streams.addListener(self._watch)
        self.query = writer.option("checkpointLocation", self.checkpoint).trigger(processingTime=f"{self.poll_interval} milliseconds").start()
        self._watch.run = str(self.query.runId)

    def check(self) -> None:
        failure = self._watch.failure
        if failure is None and self.query is not None and self.query.exception() is not None:
            failure = str(self.query.exception())
        if failure is not None:
            if self.query is not None:  # events may come late
                for progress in self.query.recentProgress:
                    self._watch.saw(progress)
            raise ChildProcessError(f"{self.name} failed in batch {self._watch.batch + 1}: {failure}")

    def stop(self) -> None:
        query, self.query = self.query, None
        if query is None:
            return
        if query.isActive and query.exception() is None:
            try:
                query.processAllAvailable()
            except Exception as error:  # noqa: BLE001  a failed write is reported, and stopping goes on
                warnings.warn(f"{self.name} could not take in all packages: {error}", stacklevel=2)
        elif query.exception() is not None:
            warnings.warn(f"{self.name} had stopped: {query.exception()}", stacklevel=2)
        query.stop()
        SparkSession.active().streams.removeListener(self._watch)


def read_log(spark: SparkSession, logger: DataLogger) -> DataFrame:
    """The entries that a logger has written as Parquet, packed or not."""
    return compact.read(spark, logger.output_directory)
