"""Digests of directories."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.digest import file_digests, folded
from tidelog.operators.discovery import walk_files

#: The file that holds a directory's digest. Fixed value.
CHECKSUM_FILE = "ax_checksum.txt"


def digests(spark: SparkSession, directory: str, excluded: set[str] = frozenset({CHECKSUM_FILE})) -> DataFrame:
    """(rel_path, digest) of each file; files are read in chunks where they are hashed."""
    files = walk_files(spark, directory).filter(~F.col("name").isin(*excluded)) if excluded else walk_files(spark, directory)
    return files.select("rel_path", file_digests("path", "rel_path").alias("digest"))


def directory_checksum(spark: SparkSession, directory: str, *, save: bool = True, excluded: set[str] | None = None) -> str:
    """The digest of all files in order of their relative paths. ValueError if there is none.

    Files are hashed and sorted in tasks; the fold, which is one chain, takes their digests as they come, a part at a time.
    """
    names = {CHECKSUM_FILE} | (excluded or set())
    ordered = digests(spark, directory, names).orderBy("rel_path")  # by UTF-8 bytes, which is by code points
    checksum = folded((r["rel_path"], bytes(r["digest"])) for r in ordered.toLocalIterator(prefetchPartitions=True))
    if checksum is None:
        raise ValueError(f"{directory} has no files")
    if save:
        with open(os.path.join(directory, CHECKSUM_FILE), "w") as file:
            file.write(checksum)
    return checksum
