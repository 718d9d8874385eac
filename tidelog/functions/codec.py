"""The entry codec as column expressions: one byte of source, eight bytes of time, low byte first, then the payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER_BYTES = 9


def entry_key(source_id: Column, time: Column) -> Column:
    """The stem of an entry's file and the name of its archive member."""
    return F.concat(F.lpad(source_id.cast("string"), 3, "0"), F.lit("_"), F.lpad(time.cast("string"), 20, "0"))


def entry_name(source_id: Column, time: Column) -> Column:
    return F.concat(entry_key(source_id, time), F.lit(".npy"))


def _turned(eight: Column) -> Column:
    return F.concat(*(F.substring(eight, k, 1) for k in range(8, 0, -1)))


def u64_bytes(value: Column) -> Column:
    """Eight bytes, low byte first, of an unsigned 64-bit number in a decimal or integer column."""
    return _turned(F.unhex(F.lpad(F.conv(value.cast("string"), 10, 16), 16, "0")))


def u64_value(eight: Column) -> Column:
    return F.conv(F.hex(_turned(eight)), 16, 10).cast("decimal(20,0)")


def header(source_id: Column, time: Column) -> Column:
    return F.concat(F.unhex(F.lpad(F.hex(source_id.cast("long")), 2, "0")), u64_bytes(time))


def encode(source_id: Column, time: Column, payload: Column) -> Column:
    return F.concat(header(source_id, time), payload)


def source_of(data: Column) -> Column:
    return F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("int")


def elapsed_of(data: Column) -> Column:
    return u64_value(F.substring(data, 2, 8))


def payload_of(data: Column) -> Column:
    return F.substring(data, HEADER_BYTES + 1, 2**31 - 1)


def payload_bytes(df: DataFrame, column: str, *, narrow: bool = False) -> Column:
    """Bytes of an array of booleans as 0 and 1; with `narrow`, of integers modulo 256. TypeError for anything else, before any run."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.BinaryType):
        return F.col(column)
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, (T.BooleanType, *((T.ShortType, T.IntegerType, T.LongType) if narrow else ()))):
        raise TypeError(f"a payload must be binary or an array of booleans, or of integers that may be narrowed, not {kind.simpleString()}")
    return F.unhex(F.array_join(F.transform(column, lambda v: F.lpad(F.hex(F.pmod(v.cast("long"), F.lit(256))), 2, "0")), ""))


def with_wire(packages: DataFrame) -> DataFrame:
    """Packages with entry_key and data. ValueError where a source id does not fit a byte is raised by the run."""
    fits = F.col("source_id").between(0, 255)
    source = F.when(fits, F.col("source_id")).otherwise(F.raise_error(F.lit("source_id must be between 0 and 255")).cast("int"))
    return packages.withColumn("entry_key", entry_key(source, F.col("acquisition_time"))).withColumn("data", encode(source, F.col("acquisition_time"), payload_bytes(packages, "serialized_data")))
