"""Discovery in directory trees, on listings as DataFrames."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import partial, reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tidelog.functions import paths
from tidelog.runtime import kept, ship
from tidelog.schema import TREE
from tidelog.sources.tree import row


#: Entries that a task lists before it hands the directories that are left back, in the first round and later.
FIRST, ROUND = 256, 1 << 14
_OPEN = StructType([*TREE.fields, StructField("open", BooleanType())])


def _list(top: str, budget: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is in directories and below, depth first, up to so many entries; then the directories that are still to be listed."""

    def found() -> Iterator[tuple]:
        listed, stack = 0, []
        for batch in batches:
            stack += reversed(batch.column(0).to_pylist())
            while stack:
                here = stack.pop()
                if listed >= budget:
                    yield (here, *[None] * (len(TREE) - 1), True)
                    continue
                with os.scandir(here) as entries:
                    for entry in entries:
                        listed += 1
                        yield (*row(top, entry), False)
                        if entry.is_dir(follow_symlinks=False):
                            stack.append(entry.path)

    rows = found()
    while part := list(islice(rows, 4096)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), _ARROW, strict=True)], _OPEN.names)


_ARROW = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.bool_())


def walk_directory(spark: SparkSession, directory: str, *, first: int = FIRST, budget: int = ROUND) -> DataFrame:
    """All entries below a directory; links are reported and not followed. A directory that can't be read is an error.

    Directories are listed in rounds: each task lists what it was dealt and what lies below, up to `budget` entries, and
    hands the rest back to be dealt anew. So a deep tree and a wide one both spread, and a chain of directories takes no
    round for each. What a round found is kept, so that all uses of the listing see the same tree.
    """
    top = os.path.abspath(directory)
    if not os.path.isdir(top):
        raise FileNotFoundError(top)
    ship(spark)
    frontier, found, most = spark.createDataFrame([(top,)], "path string"), [], first
    while True:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions")) if found else 1
        listed = kept(frontier.repartition(tasks).mapInArrow(partial(_list, top, most), _OPEN))
        found.append(listed.filter("not open").drop("open"))
        frontier, most = listed.filter("open").select("path"), budget
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, found)


def walk_files(spark: SparkSession, directory: str) -> DataFrame:
    """Entries that are files or links to files."""
    return walk_directory(spark, directory).filter("kind = 'file'")


def marker_files(listing: DataFrame, marker: str | Column) -> DataFrame:
    """The files of a name, in order of path."""
    return listing.filter((F.col("name") == marker) & (F.col("kind") == "file")).select("path").orderBy("path")


def marker_roots(markers: DataFrame, levels_up: int = 0) -> DataFrame:
    """The distinct directories of markers, or those some levels above, in order. ValueError for a negative level."""
    if levels_up < 0:
        raise ValueError("levels_up must not be negative")
    return markers.select(paths.ancestor(F.col("path"), levels_up + 1).alias("root")).distinct().orderBy("root")


def unique_roots(listed: DataFrame) -> DataFrame:
    """(ord, path) -> the distinct starts of paths up to the deepest part that no other path has, in order of first use.

    A path without such a part is an error of the run.
    """
    split = listed.select("ord", F.split("path", "/").alias("parts"))
    parts = split.select("ord", F.posexplode("parts").alias("pos", "part"))
    lone = parts.groupBy("part").agg(F.count_distinct("ord").alias("paths"), F.max(F.struct("ord", "pos")).alias("at")).filter("paths = 1")
    deepest = lone.groupBy("at.ord").agg(F.max("at.pos").alias("pos"))
    cut = split.join(deepest, "ord", "left").select("ord", F.when(F.col("pos").isNull(), F.raise_error(F.lit("a path has no part of its own")).cast("string")).otherwise(F.array_join(F.slice("parts", F.lit(1), F.col("pos") + 1), "/")).alias("root"))
    return cut.groupBy("root").agg(F.min("ord").alias("ord")).select("ord", "root")


def unaccounted(source: DataFrame, destination: DataFrame, by: str = "rel_path") -> DataFrame:
    """Entries of the destination that the source does not have."""
    return destination.join(source.select(by), by, "left_anti")
