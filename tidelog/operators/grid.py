"""Arrays of any number of dimensions as rows of blocks: each row has the place of its block, its shape, and its values as bytes.

Slices, masks and updates are transformations of the rows, so an array of any size stays spread over the cluster. Stored
arrays are Parquet in tiles of neighbouring blocks: a slice reads the tiles that it meets, an update writes those anew.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.runtime import ship

BLOCK = "start array<long>, size array<int>, block binary"
#: Values of a block, and blocks of a tile, by default.
VALUES, TILE = 1 << 16, 64
#: Bytes of blocks that a Python worker takes in hand at a time, or one block.
HAND = 4 << 20
_META = "_grid.json"


def _values(row: dict, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(row["block"], dtype).reshape(row["size"])


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of about HAND bytes, or of one row."""
    for batch in batches:
        n = max(1, batch.num_rows * HAND // max(1, batch.nbytes))
        for k in range(0, batch.num_rows, n):
            yield batch.slice(k, n)


def _batch(starts: list, sizes: list, blocks: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(starts, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(blocks, pa.binary())], ["start", "size", "block"])


def _column(values: pa.Array) -> np.ndarray:
    plain = pa.types.is_integer(values.type) or pa.types.is_floating(values.type) or pa.types.is_boolean(values.type)
    return values.to_numpy(zero_copy_only=False) if plain and not values.null_count else np.array(values.to_pylist())


def _rows(frame: DataFrame, change: Callable[[list[int], np.ndarray], Iterator[tuple[list[int], np.ndarray]]], dtype: np.dtype) -> DataFrame:
    """Each block through `change`, which gets its place and values and gives blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some(batches):
            out = [(start, list(v.shape), np.ascontiguousarray(v).tobytes()) for row in batch.to_pylist() for start, v in change(row["start"], _values(row, dtype))]
            if out:
                yield _batch(*map(list, zip(*out, strict=True)))

    ship(frame.sparkSession)
    return frame.select("start", "size", "block").mapInArrow(run, BLOCK)


@dataclass(frozen=True)
class Grid:
    """An array: `frame` has its blocks, which cover `shape` without overlap."""

    frame: DataFrame
    shape: tuple[int, ...]
    dtype: np.dtype
    path: str | None = None
    chunk: tuple[int, ...] = ()
    tile: int = TILE

    @classmethod
    def zeros(cls, spark: SparkSession, shape: tuple[int, ...], dtype: str | np.dtype, chunk: tuple[int, ...] | None = None) -> Grid:
        """ValueError for a dimension below 1 or none, TypeError for values that have no fixed size."""
        dtype = np.dtype(dtype)
        if not shape or min(shape) < 1:
            raise ValueError("an array has a dimension, and each is 1 at least")
        if dtype.hasobject:
            raise TypeError(f"values of {dtype} have no fixed size")
        side = max(1, int(VALUES ** (1 / len(shape))))
        chunk = chunk or tuple(min(n, side) for n in shape)
        counts = [-(-n // c) for n, c in zip(shape, chunk, strict=True)]

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                starts = [[int(k) * c for k, c in zip(np.unravel_index(i, counts), chunk, strict=True)] for i in batch.column(0).to_pylist()]
                sizes = [[min(c, n - s) for s, c, n in zip(start, chunk, shape, strict=True)] for start in starts]
                blocks = [bytes(prod(size) * dtype.itemsize) for size in sizes]
                yield pa.RecordBatch.from_arrays([pa.array(starts, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(blocks, pa.binary())], ["start", "size", "block"])

        ship(spark)
        return cls(spark.range(prod(counts)).mapInArrow(make, BLOCK), tuple(shape), dtype, None, tuple(chunk))

    @classmethod
    def of(cls, elements: DataFrame, shape: tuple[int, ...], dtype: str | np.dtype, chunk: tuple[int, ...] | None = None) -> Grid:
        """From rows (i0, i1, ..., value), whose values meet by block; places without a row are 0, the last row of one place counts.

        Rows come in order of their block, with a row without a value for each block that there is, and a worker fills one block at a time.
        """
        spark = elements.sparkSession
        empty = cls.zeros(spark, shape, dtype, chunk)
        dims, dtype, chunk, shape = len(shape), empty.dtype, empty.chunk, empty.shape
        counts = [-(-n // c) for n, c in zip(shape, chunk, strict=True)]
        starts, places = [f"__s{k}" for k in range(dims)], [f"i{k}" for k in range(dims)]
        given = elements.select(*((F.floor(F.col(i) / c).cast("long") * c).alias(s) for s, i, c in zip(starts, places, chunk, strict=True)), *(F.col(i).cast("long").alias(i) for i in places), "value")
        kind = given.schema["value"].dataType
        block = [F.expr(f"(id div {prod(counts[k + 1 :])}L) % {counts[k]}L * {chunk[k]}L").alias(s) for k, s in enumerate(starts)]
        every = spark.range(prod(counts)).select(*block, *(F.lit(None).cast("long").alias(i) for i in places), F.lit(None).cast(kind).alias("value"), F.lit(False).alias("given"))
        met = given.withColumn("given", F.lit(True)).unionByName(every).repartition(*starts).sortWithinPartitions(*starts)

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, block, size, out = None, None, None, ([], [], [])
            for batch in batches:
                keys = np.stack([_column(batch.column(k)) for k in range(dims)], axis=1)
                mask = batch.column(2 * dims + 1)
                place = [_column(batch.column(dims + k).filter(mask)) for k in range(dims)]
                value = _column(batch.column(2 * dims).filter(mask))
                before = np.append(0, np.cumsum(mask.to_numpy(zero_copy_only=False)))
                firsts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else []
                for first, end in zip(firsts, [*firsts[1:], len(keys)], strict=bool(len(firsts))):
                    start = keys[first].tolist()
                    if start != now:
                        if now is not None:
                            for column, cell in zip(out, (now, size, block.tobytes()), strict=True):
                                column.append(cell)
                        now, size = start, [min(c, n - s) for s, c, n in zip(start, chunk, shape, strict=True)]
                        block = np.zeros(size, dtype)
                        if len(out[2]) * prod(chunk) * dtype.itemsize >= HAND:
                            yield _batch(*out)
                            out = ([], [], [])
                    own = slice(before[first], before[end])
                    block[tuple(p[own] - s for p, s in zip(place, start, strict=True))] = value[own].astype(dtype)
            if now is not None:
                yield _batch([*out[0], now], [*out[1], size], [*out[2], block.tobytes()])

        return replace(empty, frame=met.mapInArrow(fill, BLOCK))

    def _ranges(self, key: object) -> list[range]:
        keys = key if isinstance(key, tuple) else (key,)
        if len(keys) > len(self.shape):
            raise IndexError(f"the array has {len(self.shape)} dimensions")
        out = []
        for k, n in zip((*keys, *[slice(None)] * (len(self.shape) - len(keys))), self.shape, strict=True):
            if isinstance(k, slice):
                own = range(n)[k]
                if own.step < 0:
                    raise IndexError("a step must be above 0")
                out.append(own)
            elif -n <= k < n:
                out.append(range(k % n, k % n + 1))
            else:
                raise IndexError(f"{k} is out of {n}")
        return out

    def _meeting(self, ranges: list[range]) -> DataFrame:
        """The blocks that have some of the places, by tiles where there are few of them."""
        frame = self.frame
        if "tile" in frame.columns:
            spans = [range(r.start // c, r[-1] // c + 1) if len(r) else range(0) for r, c in zip(ranges, self.chunk, strict=True)]
            counts = [-(-n // c) for n, c in zip(self.shape, self.chunk, strict=True)]
            if prod(map(len, spans)) <= 1 << 16:
                blocks = np.ravel_multi_index(np.meshgrid(*map(list, spans), indexing="ij"), counts).ravel() if all(spans) else np.zeros(0, int)
                frame = frame.filter(F.col("tile").isin(np.unique(blocks // self.tile).tolist()))
        for d, r in enumerate(ranges):
            start = F.get("start", F.lit(d))
            frame = frame.filter((start < (r[-1] + 1 if len(r) else 0)) & (start + F.get("size", F.lit(d)) > r.start))
        return frame

    def __getitem__(self, key: object) -> Grid:
        """A slice as NumPy has it, but that an index keeps its dimension, of 1. IndexError out of range."""
        ranges = self._ranges(key)

        def cut(start: list[int], values: np.ndarray) -> Iterator[tuple[list[int], np.ndarray]]:
            at, picks = [], []
            for s, n, r in zip(start, values.shape, ranges, strict=True):
                first = max(0, -(-(s - r.start) // r.step))
                last = min(len(r), -(-(s + n - r.start) // r.step))
                if first >= last:
                    return
                at.append(first)
                picks.append(slice(r[first] - s, r[last - 1] - s + 1, r.step))
            yield at, values[tuple(picks)]

        return replace(self, frame=_rows(self._meeting(ranges), cut, self.dtype), shape=tuple(map(len, ranges)), path=None, chunk=())

    def map(self, change: Callable[[np.ndarray], np.ndarray]) -> Grid:
        """Each block's values through a function of NumPy, cast to the array's type. ValueError for another shape."""

        def run(start: list[int], values: np.ndarray) -> Iterator[tuple[list[int], np.ndarray]]:
            new = np.asarray(change(values.copy()))
            if new.shape != values.shape:
                raise ValueError(f"a block of shape {values.shape} became one of {new.shape}")
            yield start, new.astype(values.dtype)

        return replace(self, frame=_rows(self.frame, run, self.dtype), path=None)

    def where(self, mask: Callable[[np.ndarray], np.ndarray], value: object) -> Grid:
        return self.map(lambda v: np.where(mask(v), value, v))

    def clip(self, low: object, high: object) -> Grid:
        return self.map(lambda v: np.clip(v, low, high))

    def elements(self) -> DataFrame:
        """Rows (i0, i1, ..., value)."""
        dims, dtype = len(self.shape), self.dtype
        kind = {"b": "boolean", "i": "long", "u": "long", "f": "double", "U": "string"}[dtype.kind]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _some(batches):
                for row in batch.to_pylist():
                    values = _values(row, dtype)
                    places = [p.ravel() + s for p, s in zip(np.indices(values.shape), row["start"], strict=True)]
                    flat = pa.array(values.ravel().tolist(), {"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}[kind])
                    yield pa.RecordBatch.from_arrays([*map(pa.array, places), flat], [*(f"i{k}" for k in range(dims)), "value"])

        ship(self.frame.sparkSession)
        return self.frame.select("start", "size", "block").mapInArrow(run, ", ".join([*(f"i{k} long" for k in range(dims)), f"value {kind}"]))

    # --- Stored arrays ---

    def _tiled(self, frame: DataFrame) -> DataFrame:
        index: object = F.lit(0).cast("long")
        for d, (n, c) in enumerate(zip(self.shape, self.chunk, strict=True)):
            index = index * -(-n // c) + F.floor(F.get("start", F.lit(d)) / c)
        return frame.select("start", "size", "block", F.floor(index / self.tile).alias("tile"))

    def save(self, path: str, *, exists_ok: bool = False) -> Grid:
        """Store the array. FileExistsError if one is there; ValueError for a slice, whose blocks lie off the grid."""
        if not self.chunk:
            raise ValueError("a slice has no grid of its own; make an array of its elements")
        if not exists_ok and os.path.exists(os.path.join(path, _META)):
            raise FileExistsError(path)
        self._tiled(self.frame).repartition("tile").write.mode("overwrite").partitionBy("tile").parquet(path)
        with open(os.path.join(path, _META), "w") as file:
            json.dump({"shape": self.shape, "chunk": self.chunk, "dtype": self.dtype.str, "tile": self.tile}, file)
        return Grid.load(self.frame.sparkSession, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Grid:
        """FileNotFoundError if there is none."""
        with open(os.path.join(path, _META)) as file:
            meta = json.load(file)
        frame = spark.read.schema(f"{BLOCK}, tile long").parquet(path)
        return cls(frame, tuple(meta["shape"]), np.dtype(meta["dtype"]), path, tuple(meta["chunk"]), meta["tile"])

    def update(self, key: object, change: Callable[[np.ndarray], object]) -> Grid:
        """Replace a slice of a stored array by change(its values in a block), which is cast to the array's type.

        Tiles that the slice does not meet are neither read nor written. Writers of one tile must not run at once: each puts
        whole tiles in place, and the last one stays.
        """
        if self.path is None:
            raise ValueError("only a stored array is updated")
        ranges = self._ranges(key)

        def run(start: list[int], values: np.ndarray) -> Iterator[tuple[list[int], np.ndarray]]:
            picks = []
            for s, n, r in zip(start, values.shape, ranges, strict=True):
                first, last = max(0, -(-(s - r.start) // r.step)), min(len(r), -(-(s + n - r.start) // r.step))
                picks.append(slice(r[first] - s, r[last - 1] - s + 1, r.step) if first < last else slice(0, 0))
            new = values.copy()
            new[tuple(picks)] = np.asarray(change(new[tuple(picks)])).astype(values.dtype)
            yield start, new

        tiles = self._meeting(ranges).select("tile").distinct()
        whole = self.frame.join(tiles, "tile", "left_semi")
        spark = self.frame.sparkSession
        self._tiled(_rows(whole, run, self.dtype)).repartition("tile").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile").parquet(self.path)
        return Grid.load(spark, self.path)
