"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that a Python worker takes in hand at a time. Documents may be long.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(batches: Iterable[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of so many rows and bytes, or of one row, so that long texts do not fill a worker."""
    for batch in batches:
        n = max(1, min(BATCH_ROWS, batch.num_rows * most // max(1, batch.nbytes)))
        if batch.num_rows <= n:
            yield batch
            continue
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, k = np.cumsum(sizes), 0
        while k < batch.num_rows:
            stop = min(k + BATCH_ROWS, max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most, "right"))), batch.num_rows)
            yield batch.slice(k, stop - k)
            k = stop


def spread(df: DataFrame) -> DataFrame:
    """A scan in as many parts as there are cores at least, so that a small file does not keep a Python stage on one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def saved(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """Cut the lineage: write to the shared checkpoint folder and read from there. Shuffle files of what is kept go.

    Python steps get Arrow batches of so many bytes at most, or of one row; else as the session has it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidelog-"))
    settings = {CLEAN_UP: True} | ({} if batch_bytes is None else {ARROW_BYTES: batch_bytes})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return df.select("*").checkpoint()  # a plan made under the settings
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def width(spark: SparkSession) -> int:
    """The number of shuffle partitions in force."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str) -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def is_space(raw: np.ndarray) -> np.ndarray:
    """Marks the bytes 20 and 09 to 0D."""
    return (raw == 32) | ((raw >= 9) & (raw <= 13))
