"""Named arrays of fixed shape and type: elements as rows, and expressions for array columns.

Processes share a version of an array, not its memory: a write makes a new version under the name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"b": "boolean", "i": "long", "u": "long", "f": "double", "U": "string"}


def position(index: Column | int, size: Column) -> Column:
    """The place, from 0, of an index that may count from the end; an error out of range."""
    index = F.lit(index) if isinstance(index, int) else index
    place = F.when(index < 0, index + size).otherwise(index)
    return F.when((place >= 0) & (place < size), place).otherwise(F.raise_error(F.lit("index out of range")).cast("int"))


def item(array: str, index: int) -> Column:
    return F.get(array, position(index, F.size(array)))


def part(array: str, start: int | None, stop: int | None) -> Column:
    """A slice as Python has it, without a step."""
    size = F.size(array)

    def edge(value: int | None, default: Column) -> Column:
        if value is None:
            return default
        return F.greatest(F.lit(0), size + value) if value < 0 else F.least(F.lit(value), size)

    first = edge(start, F.lit(0))
    return F.slice(array, first + 1, F.greatest(F.lit(0), edge(stop, size) - first))


def masked(array: str, mask, value) -> Column:  # noqa: ANN001
    """Replace elements for which mask(element) holds."""
    return F.transform(array, lambda v: F.when(mask(v), value).otherwise(v))


def clipped(array: str, low: Column, high: Column) -> Column:
    return F.transform(array, lambda v: F.least(F.greatest(v, low), high))


class SharedArray:
    """An n-dimensional array under a name of a session: rows (i0, i1, ..., value)."""

    def __init__(self, spark: SparkSession, name: str, shape: tuple[int, ...], dtype: np.dtype) -> None:
        self.spark, self.name, self.shape, self.dtype = spark, name, shape, dtype
        self.connected = True

    @classmethod
    def create(cls, spark: SparkSession, name: str, prototype: np.ndarray, *, exists_ok: bool = False) -> SharedArray:
        """TypeError for what is no array, IndexError without a dimension, ValueError if empty, FileExistsError for a name in use."""
        if not isinstance(prototype, np.ndarray) or prototype.dtype.kind not in TYPES:
            raise TypeError("the prototype must be an array of booleans, integers, floats or texts")
        if not prototype.ndim:
            raise IndexError("the prototype has no dimension")
        if not prototype.size:
            raise ValueError("the prototype is empty")
        if not exists_ok and spark.catalog.tableExists(name):
            raise FileExistsError(name)
        array = cls(spark, name, prototype.shape, prototype.dtype)
        array._publish(prototype)
        return array

    def _publish(self, values: np.ndarray) -> None:
        places = [p.ravel().tolist() for p in np.indices(values.shape)]
        schema = ", ".join([*(f"i{k} int" for k in range(values.ndim)), f"value {TYPES[self.dtype.kind]}"])
        self.spark.createDataFrame(list(zip(*places, values.ravel().tolist(), strict=True)), schema).createOrReplaceTempView(self.name)

    @property
    def frame(self) -> DataFrame:
        if not self.connected:
            raise ConnectionError(f"{self.name} is not connected")
        return self.spark.table(self.name)

    def array(self) -> np.ndarray:
        rows = self.frame.orderBy(*self.frame.columns[:-1]).select("value").collect()
        return np.array([r[0] for r in rows], self.dtype).reshape(self.shape)

    def __getitem__(self, key: int | slice) -> np.ndarray:
        return self.array()[key]

    def __setitem__(self, key: int | slice, value: object) -> None:
        """Cast to the array's type; ValueError for another shape."""
        values = self.array()
        values[key] = value
        self._publish(values)

    def where(self, mask: Column, value: object) -> None:
        """Replace the elements for which a condition on the columns holds."""
        new = self.frame.withColumn("value", F.when(mask, F.lit(value).cast(TYPES[self.dtype.kind])).otherwise(F.col("value")))
        self._publish(np.array([r["value"] for r in new.orderBy(*new.columns[:-1]).collect()], self.dtype).reshape(self.shape))

    def connect(self) -> None:
        if not self.spark.catalog.tableExists(self.name):
            raise FileNotFoundError(self.name)
        self.connected = True

    def disconnect(self) -> None:
        self.connected = False

    def destroy(self) -> None:
        self.spark.catalog.dropTempView(self.name)
        self.connected = False

    def __reduce__(self):  # noqa: ANN204
        raise TypeError("an array belongs to its session; pass its name")
