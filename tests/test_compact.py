"""A log of many batches stays one of few files, with the same rows."""

import os
from decimal import Decimal

import pytest

from tidelog.functions import codec
from tidelog.operators import archive
from tidelog.schema import PACKAGE, WIRE
from tidelog.streaming import compact

HOUR = 3_600_000_000


def batch(spark, directory, number, rows):
    frame = spark.createDataFrame([(s, Decimal(t), bytearray(d)) for s, t, d in rows], PACKAGE)
    codec.with_wire(frame).select(*WIRE.names).coalesce(1).write.parquet(os.path.join(directory, f"batch={number}"))


def files(directory):
    return [n for d, _, names in os.walk(directory) for n in names if n.endswith(".parquet")]


def shown(spark, directory):
    return sorted((r.source_id, int(r.acquisition_time), bytes(r.data)[9:]) for r in compact.read(spark, directory).collect())


def test_many_batches(spark, tmp_path):
    directory, want = str(tmp_path), {}
    for number in range(24):
        rows = [(s, number * HOUR // 3 + s, bytes([number])) for s in range(3)] + [(1, 7, bytes([number, 1]))]  # one key in every batch
        batch(spark, directory, number, rows)
        want |= {(s, t): d for s, t, d in rows}
        if number % 3 == 2:
            assert compact.compact(spark, directory, fan=3) > 0
            assert len(os.listdir(directory)) <= 3 + 1 + 2 and len(files(directory)) <= 3 + 1
    whole = sorted((*k, d) for k, d in want.items())
    seen = shown(spark, directory)
    assert [r for r in seen if r[:2] != (1, 7)] == [r for r in whole if r[:2] != (1, 7)]
    compact.compact(spark, directory, last=True, fan=1)
    assert len(files(directory)) == 1 and shown(spark, directory) == whole
    assert compact.compact(spark, directory, last=True, fan=1) == 0


def test_size_of_files(spark, tmp_path):
    directory = str(tmp_path)
    batch(spark, directory, 0, [(s, t * HOUR, os.urandom(2000)) for s in range(4) for t in range(40)])
    before = shown(spark, directory)
    compact.compact(spark, directory, last=True, file_bytes=64 << 10)
    assert 4 <= len(files(directory)) <= 8 and shown(spark, directory) == before


def test_what_does_not_count(spark, tmp_path, monkeypatch):
    directory = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        compact.read(spark, directory)
    for number in range(3):
        batch(spark, directory, number, [(1, number, b"x")])
    os.unlink(os.path.join(directory, "batch=2", "_SUCCESS"))  # still being written
    assert compact.compact(spark, directory) == 1  # of two whole ones the last may run again
    os.makedirs(os.path.join(directory, "packed-left-behind"))
    assert [r[1] for r in shown(spark, directory)] == [0, 1]
    monkeypatch.setattr(archive, "mismatches", lambda own, packed, value: own)
    with pytest.raises(ValueError, match="differ"):
        compact.compact(spark, directory, last=True)
    assert [r[1] for r in shown(spark, directory)] == [0, 1] and sum(n.startswith("packed-0") for n in os.listdir(directory)) == 1


def test_the_order_of_batches_is_not_looked_up_by_row(spark, tmp_path, monkeypatch):
    """It is the number in a folder's name, so that the work does not grow with rows times folders; numbers are not compared as text."""
    directory = str(tmp_path)
    monkeypatch.setattr(compact.F, "create_map", None)
    for number in range(8, 12):
        batch(spark, directory, number, [(1, 7, bytes([number])), (2, number, b"x")])
    assert compact.compact(spark, directory) == 3
    assert shown(spark, directory)[0] == (1, 7, bytes([10]))
    assert compact.compact(spark, directory, last=True, fan=1) == 2
    batch(spark, directory, 100, [(1, 7, b"last")])
    assert compact.compact(spark, directory, last=True, fan=1) == 2
    assert shown(spark, directory) == [(1, 7, b"last"), *((2, n, b"x") for n in range(8, 12))]
