import os
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import codec
from tidelog.operators import archive
from tidelog.plans import QUERIES
from tidelog.schema import PACKAGE, WIRE
from tidelog.sources.npz import save_entry

ONSET = 1_700_000_000_000_000


def packages(spark, rows):
    return spark.createDataFrame([(s, Decimal(t), bytearray(p)) for s, t, p in rows], PACKAGE)


def log(directory, source, count, onset=ONSET):
    rows = ([] if onset is None else [(0, onset.to_bytes(8, "little"))]) + [((i + 1) * 1000, bytes((i + j) % 256 for j in range(4))) for i in range(count)]
    for time, payload in rows:
        save_entry(str(directory), f"{source:03d}_{time:020d}", bytes([source]) + time.to_bytes(8, "little") + payload)


def test_golden_entry(spark):
    row = codec.with_wire(packages(spark, [(7, 1234567890, [10, 20, 30, 255])])).select("data", codec.entry_name(F.col("source_id"), F.col("acquisition_time")).alias("name")).first()
    assert bytes(row.data).hex() == "07d202964900000000" + "0a141eff"
    assert row.name == "007_00000000001234567890.npy"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 255), st.integers(0, 2**64 - 1), st.binary(max_size=9)), min_size=1, max_size=20))
def test_round_trip(spark, rows):
    data = F.col("data")
    back = codec.with_wire(packages(spark, rows)).select(codec.source_of(data).alias("s"), codec.elapsed_of(data).alias("t"), codec.payload_of(data).alias("p"), "data").collect()
    assert [(r.s, int(r.t), bytes(r.p)) for r in back] == rows
    assert [bytes(r.data) for r in back] == [bytes([s]) + t.to_bytes(8, "little") + p for s, t, p in rows]


def test_payload_types(spark):
    rows = spark.createDataFrame([([True, False, True], [1, 257, -1], [0.5])], "b array<boolean>, i array<long>, f array<double>")
    assert bytes(rows.select(codec.payload_bytes(rows, "b")).first()[0]) == b"\1\0\1"
    assert bytes(rows.select(codec.payload_bytes(rows, "i", narrow=True)).first()[0]) == b"\1\1\xff"
    with pytest.raises(TypeError):
        codec.payload_bytes(rows, "f", narrow=True)
    with pytest.raises(TypeError):
        codec.payload_bytes(rows, "i")
    with pytest.raises(Exception, match="between 0 and 255"):
        codec.with_wire(packages(spark, [(256, 1, b"")])).collect()


def test_messages_and_counts(spark, tmp_path):
    log(tmp_path, 1, 10)
    log(tmp_path, 200, 3, onset=5)
    entries = archive.as_packages(archive.read_entries(spark, str(tmp_path)))
    rows = archive.messages(entries, strict=True).filter("source_id = 1").orderBy("timestamp_us").collect()
    assert [int(r.timestamp_us) for r in rows] == [ONSET + (i + 1) * 1000 for i in range(10)]
    assert [bytes(r.payload) for r in rows] == [bytes((i + j) % 256 for j in range(4)) for i in range(10)]
    assert {r.source_id: r.messages for r in archive.message_counts(entries).collect()} == {1: 10, 200: 3}


def test_no_onset(spark, tmp_path):
    log(tmp_path, 1, 5, onset=None)
    entries = archive.as_packages(archive.read_entries(spark, str(tmp_path)))
    with pytest.raises(ValueError, match="onset"):
        archive.messages(entries, strict=True)
    given_ = spark.createDataFrame([(1, Decimal(100))], "source_id int, onset_us decimal(20,0)")
    assert sorted(int(r.timestamp_us) for r in archive.messages(entries, given_, strict=True).collect()) == [100 + (i + 1) * 1000 for i in range(5)]


def test_assemble_verify_and_find(spark, tmp_path):
    inner = tmp_path / "inner"
    inner.mkdir()
    log(tmp_path, 1, 4)
    log(tmp_path, 12, 2)
    log(inner, 1, 3)
    made = archive.assemble_log_archives(spark, str(tmp_path), remove_sources=False, verify_integrity=True)
    assert [os.path.basename(m) for m in made] == ["12_log.npz", "1_log.npz"]
    assert len(list(tmp_path.glob("*.npy"))) == 8
    archive.assemble_log_archives(spark, str(tmp_path))
    assert not list(tmp_path.glob("*.npy")) and len(list(inner.glob("*.npy"))) == 4
    members = np.load(tmp_path / "1_log.npz")
    assert members.files == sorted(members.files) and len(members.files) == 5
    assert archive.archive_message_count(spark, str(tmp_path / "1_log.npz")) == 4
    assert list(archive.discover_log_archives(str(tmp_path))) == ["12", "1"]
    assert archive.find_log_archive(str(tmp_path), "12") == str(tmp_path / "12_log.npz")
    archive.assemble_log_archives(spark, str(inner))
    with pytest.raises(ValueError):
        archive.find_log_archive(str(tmp_path), "1")
    for missing in (str(tmp_path), str(tmp_path / "none")):
        with pytest.raises(FileNotFoundError):
            archive.find_log_archive(missing, "77")
    with pytest.raises(FileNotFoundError):
        archive.read_archive(spark, str(tmp_path / "77_log.npz"))


def test_a_failed_check_keeps_the_entries(spark, tmp_path, monkeypatch):
    log(tmp_path, 3, 3)
    monkeypatch.setattr(archive, "mismatches", lambda own, members, value: own)
    with pytest.raises(ValueError, match="differs"):
        archive.assemble_log_archives(spark, str(tmp_path), verify_integrity=True)
    assert len(list(tmp_path.glob("*.npy"))) == 4


def test_batches(spark):
    small = spark.range(1, 1501).selectExpr("1 as source_id", "id as acquisition_time")
    large = spark.range(0, 2501).selectExpr("2 as source_id", "id as acquisition_time")
    sizes = archive.batches(small.unionByName(large), workers=2).groupBy("source_id", "batch").count().collect()
    by = {s: sorted((r.batch, r["count"]) for r in sizes if r.source_id == s) for s in (1, 2)}
    assert by[1] == [(0, 1500)]
    assert by[2] == [(k, 313) for k in range(7)] + [(7, 309)]


def test_last_write_and_native_store(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, "a", 1), (1, 5, "b", 2), (2, 5, "c", 3)], "source_id int, acquisition_time long, v string, n int")
    kept = archive.last_write(rows, "n")
    assert sorted((r.source_id, r.v) for r in kept.collect()) == [(1, "b"), (2, "c")]
    archive.store(kept, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).filter("source_id = 2").count() == 1


def test_archives_of_a_frame_take_no_file_for_each_entry(spark, tmp_path, monkeypatch):
    directory = str(tmp_path / "log")
    entries = codec.with_wire(packages(spark, [(s, t, bytes([s, t])) for s in (1, 12) for t in range(50)])).select(*WIRE.names)
    made = archive.write_archives(entries, directory, verify_integrity=True)
    assert made == [f"{directory}/12_log.npz", f"{directory}/1_log.npz"] and sorted(os.listdir(directory)) == ["12_log.npz", "1_log.npz"]
    with np.load(made[1]) as members:
        assert members.files == [f"001_{t:020d}" for t in range(50)] and members.files and members[members.files[7]].tolist() == [1, 7, 0, 0, 0, 0, 0, 0, 0, 1, 7]
    assert archive.write_archives(entries.limit(0), directory) == []

    def files(*_):
        raise AssertionError("entry files")

    monkeypatch.setattr(archive, "read_entries", files)
    for name in ("npz_roundtrip", "archive_range_scan"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    monkeypatch.setattr(archive, "mismatches", lambda own, members, value: own)
    with pytest.raises(ValueError, match="differs"):
        archive.write_archives(entries, directory, verify_integrity=True)
