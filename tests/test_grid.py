"""Arrays in blocks against NumPy."""

import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.operators.grid import Grid

SHAPE, CHUNK = (7, 10, 5), (3, 4, 2)


def dense(array):
    out = np.full(array.shape, -1).astype(array.dtype)
    for row in array.frame.collect():
        place = tuple(slice(s, s + n) for s, n in zip(row.start, row.size, strict=True))
        assert (out[place] == np.array(-1).astype(array.dtype)).all()
        out[place] = np.frombuffer(row.block, array.dtype).reshape(row.size)
    return out


@pytest.fixture(scope="module")
def numbers():
    return np.random.default_rng(1).integers(-50, 50, SHAPE).astype(np.int32)


@pytest.fixture(scope="module")
def stored(spark, numbers, tmp_path_factory):
    rows = [(*map(int, place), int(v)) for place, v in np.ndenumerate(numbers) if v]
    elements = spark.createDataFrame(rows, "i0 int, i1 int, i2 int, value int")
    return Grid.of(elements, SHAPE, np.int32, CHUNK).save(str(tmp_path_factory.mktemp("grid") / "a"))


@pytest.mark.parametrize("key", [slice(None), 0, -1, (slice(2, 6), 3), (slice(None), slice(-3, -1), slice(1, None, 2)), (slice(1, 7, 3), slice(9, 2), 0), (6, 9, 4), slice(100)])
def test_slices_are_those_of_numpy(stored, numbers, key):
    keys = key if isinstance(key, tuple) else (key,)
    want = numbers[tuple(k if isinstance(k, slice) else slice(k, k + 1 or None) for k in keys)]
    got = stored[key]
    assert got.shape == want.shape and (dense(got) == want).all()


def test_masks_clips_and_maps(stored, numbers):
    assert (dense(stored.where(lambda v: v < 0, 7)) == np.where(numbers < 0, 7, numbers)).all()
    assert (dense(stored.clip(-5, 9)) == numbers.clip(-5, 9)).all()
    assert (dense(stored[2:5].map(lambda v: v * 2.7)) == (numbers[2:5] * 2.7).astype(np.int32)).all()
    rows = stored[3, 2:4].elements()
    assert sorted(tuple(r) for r in rows.collect()) == [(*p, v) for p, v in np.ndenumerate(numbers[3:4, 2:4])]
    with pytest.raises(Exception, match="became one of"):
        stored.map(lambda v: v[:1, :1, :1] if v.size > 1 else v[None]).frame.collect()


def test_updates_write_their_tiles_alone(spark, numbers, stored, tmp_path):
    path = str(tmp_path / "b")
    array = replace(Grid.of(stored.elements(), SHAPE, np.int32, CHUNK), tile=4).save(path)
    files = lambda: {os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}
    before, own = files(), numbers.copy()
    assert len(before) == 7
    array = array.update((slice(0, 2), slice(1, 3), 0), lambda v: v + 100)
    own[0:2, 1:3, 0] += 100
    assert (dense(array) == own).all() and len(before - files()) == len(files() - before) == 1
    array = array.update(-1, lambda v: np.where(v > 0, 1.9, v))
    own[-1] = np.where(own[-1] > 0, 1, own[-1])
    assert (dense(array) == own).all() and before & files()
    plan = array[0:1, 0:1].frame._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "tile" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_types_and_errors(spark, tmp_path):
    words = np.array([["a", "bc"], ["", "é"]])
    rows = spark.createDataFrame([(*p, str(v)) for p, v in np.ndenumerate(words)], "i0 int, i1 int, value string")
    assert (dense(Grid.of(rows, (2, 2), "<U2", (1, 2))) == words).all()
    flags = Grid.zeros(spark, (5,), bool).map(lambda v: ~v)
    assert [r.value for r in flags.elements().collect()] == [True] * 5
    assert Grid.zeros(spark, (5, 5), np.float64)[::2, 4].shape == (3, 1)
    for key in (5, -6, (0, 0), slice(None, None, -1)):
        with pytest.raises(IndexError):
            _ = flags[key]
    for shape in ((), (0,), (3, 0)):
        with pytest.raises(ValueError, match="dimension"):
            Grid.zeros(spark, shape, int)
    with pytest.raises(TypeError):
        Grid.zeros(spark, (1,), object)
    path = str(tmp_path / "c")
    with pytest.raises(FileNotFoundError):
        Grid.load(spark, path)
    flags.save(path)
    with pytest.raises(FileExistsError):
        flags.save(path)
    assert flags.save(path, exists_ok=True).dtype == bool
    with pytest.raises(ValueError, match="grid of its own"):
        flags[1:].save(path)
    with pytest.raises(ValueError, match="stored"):
        flags.update(0, lambda v: v)


def test_large_array_stays_in_tasks(spark):
    array = Grid.zeros(spark, (3000, 2000), np.float32, (500, 500)).map(lambda v: v + 1).clip(0, 0.5)
    total = array[1000:, ::4].elements().agg(F.sum("value"), F.count("*")).first()
    assert tuple(total) == (500_000.0, 1_000_000)


def test_blocks_are_filled_one_at_a_time(spark):
    """A worker holds a few blocks, not all that an Arrow batch brings as Python values; and a block's values may come in several batches."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.range(0, 40 * 64).select(F.expr("cast(id div 64 as int)").alias("i0"), F.expr("cast(id % 64 as int)").alias("i1"), F.expr("if(id = 77, null, id * 0.5D)").alias("value"))
    want = np.arange(40 * 64).reshape(40, 64) * 0.5
    want[1, 13] = np.nan
    want = np.pad(want, ((0, 9), (0, 3)))
    for most in (7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            array = Grid.of(rows, (49, 67), float, (8, 16))
            assert np.array_equal(dense(array), want, equal_nan=True) and array.frame.count() == 35
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plan = array.frame._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Join" not in plan
    with pytest.raises(Exception, match="negative|out of bounds"):
        Grid.of(rows, (49, 60), float, (8, 16)).frame.collect()
