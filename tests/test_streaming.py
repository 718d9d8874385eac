import os
import time
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.operators import archive
from tidelog.plans import storage
from tidelog.schema import PACKAGE
from tidelog.streaming.decode import decoded
from tidelog.streaming.ingest import DataLogger, entry_stream, package_stream, read_log
from tidelog.streaming.producers import SCHEMA, InboxReader, Producer, producer_stream


def put(spark, inbox, rows):
    spark.createDataFrame([(s, Decimal(t), bytearray(b"x")) for s, t in rows], PACKAGE).write.mode("append").parquet(inbox)


def test_all_that_was_there_is_taken_in(spark, tmp_path):
    inbox = str(tmp_path / "inbox")
    put(spark, inbox, [(1, 5), (2, 6)])
    logger = DataLogger(str(tmp_path), "rig", thread_count=2)
    stream = package_stream(spark, inbox)
    logger.start(stream)
    logger.start(stream)
    assert logger.alive
    put(spark, inbox, [(1, 7), (2, 8)])
    logger.stop()
    logger.stop()
    assert not logger.alive
    assert sorted((r.source_id, int(r.acquisition_time)) for r in read_log(spark, logger).collect()) == [(1, 5), (1, 7), (2, 6), (2, 8)]


def test_entry_files_are_consolidated(spark, tmp_path):
    inbox = str(tmp_path / "inbox")
    put(spark, inbox, [(1, k) for k in range(5)])
    logger = DataLogger(str(tmp_path), "rig", entry_files=True)
    logger.start(package_stream(spark, inbox))
    logger.stop()
    seen = entry_stream(spark, logger.output_directory).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    seen.awaitTermination()
    assert spark.table("seen").count() == 5
    assert len(archive.assemble_log_archives(spark, logger.output_directory, verify_integrity=True)) == 1


def test_a_failed_write_is_told(spark, tmp_path):
    inbox = str(tmp_path / "inbox")
    put(spark, inbox, [(999, 1)])
    logger = DataLogger(str(tmp_path), "rig")
    logger.start(package_stream(spark, inbox))
    query = logger.query
    with pytest.raises(Exception, match="between 0 and 255"):
        query.awaitTermination(60)
    with pytest.raises(ChildProcessError):
        logger.check()
    with pytest.warns(UserWarning, match="rig"):
        logger.stop()


def taken(spark, logger):
    return sorted((r.source_id, int(r.acquisition_time)) for r in read_log(spark, logger).collect())


def test_many_producers_and_restarts(spark, tmp_path):
    """Five writers at once, batches of few files, and two restarts from the checkpoint: each entry once."""
    inbox = str(tmp_path / "inbox")
    logger = DataLogger(str(tmp_path), "rig", thread_count=2)

    def produce(k, start):
        producer = Producer(inbox, f"rig{k}")
        for t in range(start, start + 6):
            producer.put([(k, 2 * t, b"a"), (k, 2 * t + 1, b"b")])

    def all_at_once(start):
        with ThreadPoolExecutor(5) as pool:
            list(pool.map(lambda k: produce(k, start), range(5)))

    for start in (0, 6, 12):
        logger.start(producer_stream(spark, inbox, files_per_trigger=7))
        all_at_once(start)
        if start == 6:
            logger.query.stop()  # without taking in what waits
            logger.query = None
        else:
            logger.stop()
    assert taken(spark, logger) == [(k, t) for k in range(5) for t in range(36)]
    batches = [p for p in os.listdir(logger.output_directory) if p.startswith("batch=")]
    assert len(batches) >= 90 // 7


def test_admission_is_dealt_in_turn(tmp_path):
    for name, n in (("a", 1), ("b", 9), ("c", 3)):
        producer = Producer(str(tmp_path), name)
        for k in range(n):
            producer.put([(1, k, b"")])
    reader = InboxReader({"path": str(tmp_path), "maxfilespertrigger": "6"})
    ends = [reader.initialOffset()]
    for _ in range(4):
        ends.append(reader.latestOffset())
        reader = InboxReader({"path": str(tmp_path), "maxfilespertrigger": "6"}) if len(ends) == 3 else reader
        parts = reader.partitions(ends[-2], ends[-1])
        assert sum(len(p.paths) for p in parts) == sum(ends[-1].values()) - sum(ends[-2].values())
    assert ends == [{}, {"a": 1, "b": 3, "c": 2}, {"a": 1, "b": 8, "c": 3}, {"a": 1, "b": 9, "c": 3}, {"a": 1, "b": 9, "c": 3}]


def test_producers_go_on_and_do_not_overwrite(tmp_path):
    first, second = Producer(str(tmp_path), "x"), Producer(str(tmp_path), "x")
    first.put([(1, 2**64 - 1, b"\0")])
    with pytest.raises(FileExistsError):
        second.put([(1, 2, b"")])
    Producer(str(tmp_path), "x").put([])
    reader = InboxReader({"path": str(tmp_path), "clean": "true"})
    (part,) = reader.partitions({}, reader.latestOffset())
    assert [len(batch) for batch in reader.read(part)] == [1] and sorted(os.listdir(tmp_path / "x"))[-1].startswith("0" * 19 + "1")
    reader.commit({"x": 2})
    assert [n for n in os.listdir(tmp_path / "x") if n.endswith(".arrow")] == ["0" * 19 + "1.arrow"]
    again = InboxReader({"path": str(tmp_path), "clean": "true"})
    assert again.latestOffset() == {"x": 2} and Producer(str(tmp_path), "x").next == 2
    for bad in ("", ".x", "_x", "a/b"):
        with pytest.raises(ValueError, match="name of a producer"):
            Producer(str(tmp_path), bad)


@pytest.mark.parametrize("entry_files", [False, True])
def test_a_failure_is_raised_at_the_next_call(spark, tmp_path, entry_files):
    logger = DataLogger(str(tmp_path), "rig", entry_files=entry_files)
    logger.put((1, 1, b"x"), (2, 1, b"y"))
    logger.start()
    logger.query.processAllAvailable()
    logger.put((999, 1, b"x"))
    with pytest.raises(Exception, match="between 0 and 255"):
        logger.query.awaitTermination(60)
    with pytest.raises(ChildProcessError, match="rig failed in batch 1"):
        for _ in range(100):
            logger.put((1, 2, b"x"))
            time.sleep(0.05)
    with pytest.warns(UserWarning, match="rig"):
        logger.stop()


def test_messages_do_not_depend_on_the_order_of_arrival(spark, tmp_path):
    random = np.random.default_rng(2)
    rows = [(s, 0, (1000 * s).to_bytes(8, "little")) for s in (1, 2, 3)] + [(s, int(t), bytes([s, t % 256])) for s in (1, 2, 3, 4) for t in range(1, 30)]
    frame = spark.createDataFrame([(s, Decimal(t), bytearray(p)) for s, t, p in rows], PACKAGE)
    want = sorted((r.source_id, int(r.timestamp_us), bytes(r.payload)) for r in archive.messages(frame.withColumn("entry_key", F.lit(""))).collect())
    assert len(want) == 87  # nothing of source 4, which has no onset
    for run in range(2):
        inbox = str(tmp_path / f"inbox{run}")
        producer = Producer(inbox, "p")
        for k in random.permutation(len(rows)).reshape(7, -1):
            producer.put([rows[i] for i in k])
        out, seen = str(tmp_path / f"out{run}"), str(tmp_path / f"checkpoint{run}")
        for _ in range(2):  # the second start finds nothing new
            stream = decoded(producer_stream(spark, inbox, files_per_trigger=2))
            query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).start()
            query.processAllAvailable()
            query.stop()
        assert sorted((r.source_id, int(r.timestamp_us), bytes(r.payload)) for r in spark.read.parquet(out).collect()) == want


def test_batches_share_files(spark, tmp_path):
    """A stream pays for each file, so producers make few of many batches, none much larger than asked for."""
    batches = [pa.RecordBatch.from_arrays([pa.array([k] * 100, pa.int32()), pa.array(range(100), pa.decimal128(20, 0)), pa.array([b"x"] * 100)], schema=SCHEMA) for k in range(30)]
    producer = Producer(str(tmp_path / "a"), "p")
    producer.put_all(batches, file_bytes=3 * batches[0].nbytes)
    producer.put_all([])
    reader = InboxReader({"path": str(tmp_path / "a")})
    (part,) = reader.partitions({}, reader.latestOffset())
    assert len(part.paths) == producer.next == 10
    assert pa.Table.from_batches(reader.read(part)) == pa.Table.from_batches(batches)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        inbox = storage._inbox(spark, "/root/testdata/sf0.001", str(tmp_path))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert 1 <= sum(n.endswith(".arrow") for _, _, names in os.walk(inbox) for n in names) <= 5
