"""Packing of a log that a stream has written: a folder for each batch becomes files of an even size, by source and hour."""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import archive

#: Which folders are the log: the packed ones, and of the batches' those past the last packed one.
MANIFEST = "_packed.json"
#: Bytes of a file, packed folders that are packed again into one when there are so many, and microseconds of an hour.
FILE, FAN, HOUR = 128 << 20, 8, 3_600_000_000


def manifest(directory: str) -> dict:
    try:
        with open(os.path.join(directory, MANIFEST)) as file:
            return json.load(file)
    except FileNotFoundError:
        return {"through": -1, "folders": []}


def _batches(directory: str, after: int) -> list[int]:
    """Batches that are there as a whole, past a number."""
    with os.scandir(directory) as found:
        numbers = [int(e.name[6:]) for e in found if e.name.startswith("batch=") and e.name[6:].isdigit()]
    return sorted(n for n in numbers if n > after and os.path.exists(os.path.join(directory, f"batch={n}", "_SUCCESS")))


def live(directory: str) -> list[str]:
    """The folders that make up the log."""
    packed = manifest(directory)
    return [os.path.join(directory, name) for name in (*packed["folders"], *(f"batch={n}" for n in _batches(directory, packed["through"])))]


def read(spark: SparkSession, directory: str) -> DataFrame:
    """The entries of a log, packed or not. FileNotFoundError if it has none."""
    folders = live(directory)
    if not folders:
        raise FileNotFoundError(f"{directory} has no entries")
    return spark.read.option("recursiveFileLookup", True).parquet(*folders).select("source_id", "acquisition_time", "entry_key", "data")


def _size(folder: str) -> int:
    return sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet"))


def compact(spark: SparkSession, directory: str, *, last: bool = False, file_bytes: int = FILE, fan: int = FAN) -> int:
    """Pack the batches that are final, and packed folders when there are `fan` of them; returns the number of folders packed.

    The last batch may still run again and is left, unless `last` says that the stream has ended. Of entries with one key the
    one of the latest batch stays. What was packed is read back and compared before it counts; ValueError if it differs. The
    manifest then changes in one step, so a reader that begins at any time sees each entry once; folders that no longer
    count go after that. One compaction of a log runs at a time.
    """
    packed = manifest(directory)
    numbers = _batches(directory, packed["through"])
    numbers = numbers if last else numbers[:-1]
    again = packed["folders"] if len(packed["folders"]) + bool(numbers) > fan else []
    names = [*again, *(f"batch={n}" for n in numbers)]
    if not numbers and len(names) < 2:
        return 0
    through = max([packed["through"], *numbers])
    paths = [os.path.join(directory, name) for name in names]
    # A later folder holds later batches; the number of its last one is in its name and orders entries with one key.
    batch = F.regexp_extract("_metadata.file_path", r"/(?:batch=|packed-)(\d+)[^/]*/[^/]*$", 1).cast("long")
    rows = spark.read.option("recursiveFileLookup", True).parquet(*paths)
    rows = rows.select("source_id", "acquisition_time", "entry_key", "data", batch.alias("folder"))
    entries = archive.last_write(rows, "folder").select("source_id", "acquisition_time", "entry_key", "data")
    name = f"packed-{through:020d}-{uuid.uuid4().hex}"
    target = os.path.join(directory, name)
    files = max(1, -(-sum(map(_size, paths)) // file_bytes))
    hour = F.floor(F.col("acquisition_time") / HOUR)
    entries.repartitionByRange(files, "source_id", hour).sortWithinPartitions("source_id", "acquisition_time").write.parquet(target)
    bad = archive.mismatches(entries, spark.read.parquet(target), "data").first()
    if bad is not None:
        shutil.rmtree(target)
        raise ValueError(f"the packed entries of source {bad['source_id']} in {directory} differ from the batches")
    left = [n for n in packed["folders"] if n not in again]
    part = os.path.join(directory, f"{MANIFEST}.{uuid.uuid4().hex}")
    with open(part, "w") as file:
        json.dump({"through": through, "folders": [*left, name]}, file)
    os.replace(part, os.path.join(directory, MANIFEST))
    for path in paths:
        shutil.rmtree(path)
    return len(names)
