"""Moving directory trees: plan, copy, verify, remove."""

from __future__ import annotations

import os
import shutil
import time
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidelog.functions.paths import target
from tidelog.operators.discovery import unaccounted, walk_directory
from tidelog.operators.integrity import CHECKSUM_FILE, directory_checksum

TRIES, PAUSE = 5, 0.5


def delete_directory(path: str) -> bool:
    """Remove a tree; links go, this one too, and what they point to stays. Tries again some times, then warns."""
    if os.path.islink(path) or os.path.isfile(path):
        os.unlink(path)
        return True
    for _ in range(TRIES):
        try:
            shutil.rmtree(path)
        except FileNotFoundError:
            return True
        except OSError:
            time.sleep(PAUSE)
        else:
            return True
    warnings.warn(f"{path} could not be removed", stacklevel=2)
    return False


def transfer_directory(spark: SparkSession, source: str, destination: str, *, verify_integrity: bool = False, remove_source: bool = False, reset_dirty_destination: bool = False) -> None:
    """Copy a tree. The checks come in this order, before anything is written but the destination itself.

    FileNotFoundError without a source; RuntimeError for links, for entries that are neither files nor directories, with
    verify_integrity for a source without a file that a digest covers, and for a destination with files of its own,
    unless these may go; all else there stays. With verify_integrity the source's stored digest, or a fresh one, must
    be that of the copy; RuntimeError otherwise, and the source stays.
    """
    if not os.path.isdir(source):
        raise FileNotFoundError(source)
    if os.path.islink(source):
        raise RuntimeError(f"{source} is a link")
    listing = walk_directory(spark, source).persist()
    try:
        if not listing.filter("is_link").isEmpty():
            raise RuntimeError(f"{source} holds links")
        if not listing.filter("kind NOT IN ('file', 'dir')").isEmpty():
            raise RuntimeError(f"{source} holds what can't be copied")
        if verify_integrity and listing.filter((F.col("kind") == "file") & (F.col("name") != CHECKSUM_FILE)).isEmpty():
            raise RuntimeError(f"{source} has no files to verify")
        os.makedirs(destination, exist_ok=True)
        extra = unaccounted(listing, walk_directory(spark, destination).filter((F.col("kind") != "dir") & (F.col("name") != CHECKSUM_FILE)))
        if not extra.isEmpty():
            if not reset_dirty_destination:
                raise RuntimeError(f"{destination} holds files that {source} does not")

            def remove(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for part in parts:
                    for path in part["path"]:
                        os.unlink(path)
                    yield part

            extra.select("path").mapInPandas(remove, "path string").count()
        stored = os.path.join(source, CHECKSUM_FILE)
        reused = os.path.isfile(stored)
        if verify_integrity and not reused:
            directory_checksum(spark, source)
            shutil.copy2(stored, os.path.join(destination, CHECKSUM_FILE))
        for row in listing.filter("kind = 'dir'").select("rel_path").orderBy("depth", "rel_path").toLocalIterator():
            os.makedirs(os.path.join(destination, row["rel_path"]), exist_ok=True)

        def copy(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for a, b in zip(part["path"], part["copy"], strict=True):
                    shutil.copy2(a, b)
                yield part[["copy"]]

        listing.filter("kind = 'file'").select("path", target(destination, F.col("rel_path")).alias("copy")).mapInPandas(copy, "copy string").count()
        if verify_integrity:
            with open(stored) as file:
                expected = file.readline().strip()
            if directory_checksum(spark, destination, save=False) != expected:
                why = "the stored checksum of the source may be out of date" if reused else "the copy is damaged"
                raise RuntimeError(f"{destination} does not have the checksum of {source}: {why}")
    finally:
        listing.unpersist()
    if remove_source:
        delete_directory(source)
