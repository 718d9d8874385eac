"""Scans that open what is wanted, and sinks that show all they wrote or nothing."""

import json
import os
import shutil
import zipfile
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import Row

from tidelog.functions import codec
from tidelog.operators import archive
from tidelog.plans.storage import local_path
from tidelog.schema import PACKAGE, WIRE
from tidelog.sources import npz, register


def key(source, time):
    return f"{source:03d}_{time:020d}"


def stored(source, time):
    return bytes([source]) + time.to_bytes(8, "little") + b"payload"


@pytest.fixture
def log(tmp_path):
    for source in range(1, 6):
        for k in range(40):
            npz.save_entry(str(tmp_path), key(source, k * 1000), stored(source, k * 1000))
    return str(tmp_path)


def scanned(kind, options, wanted=npz.Wanted()):
    reader = kind(options | {"wanted": wanted.option()})
    return [row for part in reader.partitions() for row in reader.read(part)]


ASKED = npz.Wanted(sources=frozenset({3}), low=5000, high=9000)


def test_only_wanted_entry_files_are_opened(log, monkeypatch):
    opened = []
    load = np.load
    monkeypatch.setattr(np, "load", lambda path, **k: opened.append(path) or load(path, **k))
    rows = scanned(npz.EntryReader, {"path": log}, ASKED)
    assert [(r[0], int(r[1])) for r in rows] == [(3, k * 1000) for k in range(5, 10)] and len(opened) == 5
    opened.clear()
    assert len(scanned(npz.EntryReader, {"path": log}, npz.Wanted(keys=frozenset({key(1, 0), key(2, 7)})))) == len(opened) == 1
    opened.clear()
    assert len(scanned(npz.EntryReader, {"path": log})) == len(opened) == 200


def test_only_wanted_members_are_opened(spark, log, monkeypatch):
    made = archive.assemble_log_archives(spark, log)
    with zipfile.ZipFile(made[2], "a") as file:
        for name, time in (("other name", 6500), ("and another", 1)):
            with file.open(f"{name}.npy", "w") as member:
                np.lib.format.write_array(member, np.frombuffer(stored(3, time), np.uint8))
    opened = []
    real = zipfile.ZipFile.open
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, name, *a, **k: opened.append(name) or real(self, name, *a, **k))
    for split in (1 << 20, 700):  # an archive in one part, and in many
        opened.clear()
        rows = scanned(npz.MemberReader, {"archives": json.dumps(made), "split": str(split)}, ASKED)
        assert [(r[0], int(r[1]), r[4]) for r in rows] == [(3, k * 1000, k) for k in range(5, 10)] + [(3, 6500, 40)]
        assert len(opened) == 7  # and the two whose names say nothing
    assert [r[3] for r in scanned(npz.MemberReader, {"path": made[2], "names_only": "true"})] == [None] * 42 and len(opened) == 7


def test_scans_of_one_directory_do_not_meddle(spark, log):
    all_ = archive.read_entries(spark, log)
    few = archive.read_entries(spark, log, ASKED)
    assert all_.count() == 200 and few.count() == 5 and all_.count() == 200
    both = all_.filter("source_id = 1").unionByName(all_.filter("source_id = 3")).unionByName(few)
    assert both.count() == 85 and all_.count() == 200
    assert sorted(map(str, few.collect())) == sorted(map(str, all_.filter("source_id = 3 and acquisition_time between 5000 and 9000").collect()))
    # A damaged file outside of what is wanted is never read.
    with open(os.path.join(log, f"{key(9, 9)}.npy"), "w") as file:
        file.write("damaged")
    assert archive.read_entries(spark, log, ASKED).count() == 5
    with pytest.raises(Exception, match="npy|magic|pickle"):
        archive.read_entries(spark, log).collect()


def test_archives_of_other_sources_are_not_opened(spark, log):
    made = archive.assemble_log_archives(spark, log)
    with open(made[0], "w") as file:
        file.write("damaged")
    assert archive.read_archives(spark, made, npz.Wanted(sources=frozenset({2, 5}))).count() == 80
    assert archive.read_archives(spark, made, npz.Wanted(sources=frozenset())).count() == 0
    with pytest.raises(Exception, match="zip"):
        archive.read_archives(spark, made).count()


def test_headers(tmp_path):
    npz.save_entry(str(tmp_path), "001_odd", stored(7, 2**63 + 5))
    (row,) = scanned(npz.EntryReader, {"path": str(tmp_path)})
    assert row[:3] == (7, Decimal(2**63 + 5), "001_odd")
    npz.save_entry(str(tmp_path), "short", b"12345678")
    with pytest.raises(ValueError, match="short has no header"):
        scanned(npz.EntryReader, {"path": str(tmp_path)})


def wire(spark, rows):
    frame = spark.createDataFrame([(s, Decimal(t), bytearray(b"x")) for s, t in rows], PACKAGE)
    return codec.with_wire(frame).select(*WIRE.names)


def test_entry_sink(spark, tmp_path):
    register(spark)
    directory = str(tmp_path / "log")
    rows = wire(spark, [(s, t) for s in (1, 2) for t in range(30)]).repartition(4)
    rows.write.format("npylog").mode("append").save(directory)
    rows.limit(5).write.format("npylog").mode("append").save(directory)
    assert sorted(os.listdir(directory)) == sorted(f"{key(s, t)}.npy" for s in (1, 2) for t in range(30))
    assert sorted(map(str, spark.read.format("npylog").load(directory).collect())) == sorted(map(str, rows.collect()))


@pytest.mark.parametrize("sink", ["npylog", "npzlog"])
def test_a_killed_task_leaves_nothing_and_the_next_run_all(spark, tmp_path, sink):
    register(spark)
    directory, flag = str(tmp_path / "log"), str(tmp_path / "flag")
    rows = wire(spark, [(s, t) for s in (1, 2) for t in range(200)]).repartition("source_id").sortWithinPartitions("source_id", "acquisition_time")

    def dies(parts):
        for k, part in enumerate(parts):
            yield part
            if not os.path.exists(flag):
                open(flag, "w").close()
                os._exit(1)  # as a lost worker

    fatal = rows.mapInPandas(dies, WIRE).coalesce(4)
    with pytest.raises(Exception, match="exited|crashed|EOF|aborted"):
        fatal.write.format(sink).mode("append").save(directory)
    assert not os.path.isdir(directory) or os.listdir(directory) == []
    rows.write.format(sink).mode("append").save(directory)
    assert len(os.listdir(directory)) == (400 if sink == "npylog" else 2)
    if sink == "npzlog":
        with np.load(os.path.join(directory, "2_log.npz")) as members:
            assert members.files == [key(2, t) for t in range(200)]


def test_of_several_attempts_one_counts(tmp_path):
    entries = [Row(source_id=s, entry_key=key(s, t), data=stored(s, t)) for s in (1, 2) for t in range(3)]
    writer = npz.ArchiveWriter({"path": str(tmp_path)})
    first = writer.write(iter(entries))

    def half():
        yield entries[0]
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(half())
    writer.write(iter(entries))  # a speculative copy whose message never arrives
    assert os.listdir(tmp_path) == [os.path.basename(writer.staging)]
    writer.commit([first, None])
    assert sorted(os.listdir(tmp_path)) == ["1_log.npz", "2_log.npz"]
    with np.load(tmp_path / "1_log.npz") as members:
        assert members.files == [key(1, t) for t in range(3)]


def test_a_source_in_two_tasks_or_out_of_order_is_refused(tmp_path):
    entries = [Row(source_id=s, entry_key=key(s, 1), data=stored(s, 1)) for s in (1, 2, 1)]
    writer = npz.ArchiveWriter({"path": str(tmp_path)})
    with pytest.raises(ValueError, match="order"):
        writer.write(iter(entries))
    parts = [writer.write(iter(entries[:1])), writer.write(iter(entries[2:]))]
    with pytest.raises(ValueError, match="several tasks"):
        writer.commit(parts)
    assert os.listdir(tmp_path) == []


def test_paths_as_hadoop_names_them(spark, tmp_path):
    assert {local_path(p) for p in ("/a/b c", "file:/a/b%20c", "file:///a/b%20c")} == {"/a/b c"}
    for other in ("hdfs://host/a", "s3a://bucket/a", "viewfs://store/a"):
        with pytest.raises(ValueError, match="mount"):
            local_path(other)
    shutil.rmtree(tmp_path)


def test_members_are_read_many_at_a_time(tmp_path, monkeypatch):
    """However others have written them, and none unseen that was damaged."""
    path, arrays = str(tmp_path / "3_log.npz"), {}
    for k in range(20):
        arrays[key(3, k)] = np.frombuffer(stored(3, k), np.uint8)
    arrays["wide"] = np.asfortranarray(np.frombuffer(stored(3, 99), np.uint8).reshape(4, 4))
    arrays["long"] = np.frombuffer(stored(3, 77), np.uint16)
    opened = []
    real = zipfile.ZipFile.open
    for save, opens in ((np.savez, 0), (np.savez_compressed, 22)):
        save(path, **arrays)
        monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, name, *a, **k: opened.append(name) or real(self, name, *a, **k))
        reader = npz.MemberReader({"path": path})
        batches = [batch for part in reader.partitions() for batch in reader.read(part)]
        assert len(batches) == 1 and len(opened) == opens
        monkeypatch.setattr(zipfile.ZipFile, "open", real)
        assert [tuple(row.values()) for row in batches[0].to_pylist()] == [(r[0], r[1], n, r[3], k) for k, (n, a) in enumerate(arrays.items()) for r in [npz.row(n, a)]]
    np.savez(path, **arrays)
    with open(path, "r+b") as file:
        file.seek(file.read().index(b"payload"))
        file.write(b"P")
    with pytest.raises(zipfile.BadZipFile, match="CRC"):
        list(npz.MemberReader({"path": path}).read(npz.Span(path, 0, 1 << 30)))
