"""Entries and archives as DataFrames: grouping, onsets, decoding, batches, consolidation and its check."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import codec
from tidelog.operators.cuts import ROWS, numbered
from tidelog.sources import register
from tidelog.sources.npz import Wanted
from tidelog.sources.tree import walk

#: Entries below which reading is not split, and how many batches each worker gets.
LEAST_SPLIT, BATCHES_PER_WORKER = 2000, 4


def last_write(packages: DataFrame, order: str) -> DataFrame:
    """Of packages with one key, the last in `order` replaces the others."""
    rest = [c for c in packages.columns if c not in ("source_id", "acquisition_time")]
    latest = packages.groupBy("source_id", "acquisition_time").agg(F.max_by(F.struct(*rest), order).alias("row"))
    return latest.select("source_id", "acquisition_time", "row.*")


def grouped(packages: DataFrame, value: str) -> DataFrame:
    """One row for each source: its values in order of time. For sources of bounded size; archives stay in rows."""
    pairs = F.sort_array(F.collect_list(F.struct("acquisition_time", value)))
    return packages.groupBy("source_id").agg(F.transform(pairs, lambda p: p[value]).alias(value))


def onsets(packages: DataFrame, order: str | None = None) -> DataFrame:
    """The first entry at time 0 of each source holds the time that the others count from: (source_id, onset_us).

    First in `order`; by default the place in the archive if that is a column, else the key.
    """
    order = order or ("place" if "place" in packages.columns else "entry_key")
    first = packages.filter(F.col("acquisition_time") == 0).groupBy("source_id").agg(F.min_by("serialized_data", order).alias("data"))
    return first.select("source_id", codec.u64_value(F.col("data")).alias("onset_us"))


def after_onset(packages: DataFrame) -> DataFrame:
    """Entries that follow their source's first onset: in place of the archive if that is a column, all of them where there is no
    onset; else all that are not at time 0."""
    if "place" not in packages.columns:
        return packages.filter(F.col("acquisition_time") != 0)
    first = packages.filter(F.col("acquisition_time") == 0).groupBy("source_id").agg(F.min("place").alias("onset_place"))
    return packages.join(first, "source_id", "left").filter(F.col("onset_place").isNull() | (F.col("place") > F.col("onset_place"))).drop("onset_place")


def messages(packages: DataFrame, onset: DataFrame | None = None, *, strict: bool = False) -> DataFrame:
    """Entries after the onset with absolute time: (source_id, timestamp_us, payload).

    onset may give (source_id, onset_us) from elsewhere. Sources without an onset give no rows; strict makes that a
    ValueError. The join is broadcast by Spark where the onsets are few.
    """
    known = onsets(packages) if onset is None else onset
    if strict and not packages.join(known, "source_id", "left_anti").isEmpty():
        raise ValueError("a source has no onset entry and none was given")
    rows = after_onset(packages).join(known, "source_id")
    return rows.select("source_id", (F.col("onset_us") + F.col("acquisition_time")).cast("decimal(20,0)").alias("timestamp_us"), F.col("serialized_data").alias("payload"))


def of_keys(packages: DataFrame, keys: DataFrame) -> DataFrame:
    """The entries whose entry_key is asked for."""
    return packages.join(keys.select("entry_key"), "entry_key", "left_semi")


def message_counts(packages: DataFrame) -> DataFrame:
    """Entries other than onsets for each source, 0 where there is only an onset."""
    return packages.groupBy("source_id").agg(F.count_if(F.col("acquisition_time") != 0).alias("messages"))


def batches(packages: DataFrame, workers: int, multiplier: int = BATCHES_PER_WORKER, *, rows: int = ROWS) -> DataFrame:
    """Entries other than onsets with a batch number: consecutive runs of each source in order of time.

    A source with more than `rows` entries is numbered in parts, so that it does not fill one task.
    """
    kept = packages.filter(F.col("acquisition_time") != 0)
    counts = kept.groupBy("source_id").agg(F.count("*").alias("total"))
    size = F.when(F.col("total") < LEAST_SPLIT, F.col("total")).otherwise(F.greatest(F.lit(1), F.ceil(F.col("total") / (max(1, workers) * multiplier))))
    placed = numbered(kept, "source_id", "acquisition_time", "place", rows).join(counts, "source_id")
    return placed.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("long")).drop("place", "total")


def mismatches(original: DataFrame, archived: DataFrame, value: str) -> DataFrame:
    """Keys whose value differs between two sets of entries or is in one alone."""
    left = original.select("source_id", "acquisition_time", F.col(value).alias("ours"), F.lit(True).alias("here"))
    right = archived.select("source_id", "acquisition_time", F.col(value).alias("theirs"), F.lit(True).alias("there"))
    both = left.join(right, ["source_id", "acquisition_time"], "full")
    differs = ~F.col("ours").eqNullSafe(F.col("theirs")) | F.col("here").isNull() | F.col("there").isNull()
    return both.filter(differs).select("source_id", "acquisition_time", "ours", "theirs")


def store(packages: DataFrame, path: str, mode: str = "append") -> None:
    """The native archive: Parquet by source, in order of time."""
    packages.repartition("source_id", F.floor(F.col("acquisition_time") / 3_600_000_000)).sortWithinPartitions("source_id", "acquisition_time").write.mode(mode).partitionBy("source_id").parquet(path)


def _scan(spark: SparkSession, kind: str, wanted: Wanted | None, **options: object) -> DataFrame:
    register(spark)
    reader = spark.read.format(kind).options(**options)
    return (reader.option("wanted", wanted.option()) if wanted else reader).load()


def read_entries(spark: SparkSession, log_directory: str, wanted: Wanted | None = None) -> DataFrame:
    """The entry files of one log directory, not of those below it; of these, only what is wanted is opened."""
    return _scan(spark, "npylog", wanted, path=log_directory)


def read_archive(spark: SparkSession, path: str, wanted: Wanted | None = None, *, names_only: bool = False) -> DataFrame:
    """The members of an archive, or their names alone; FileNotFoundError if there is none."""
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    return _scan(spark, "npzlog", wanted, path=path, names_only=names_only)


def read_archives(spark: SparkSession, archives: list[str], wanted: Wanted | None = None) -> DataFrame:
    """The members of several archives. Archives of other sources than the wanted ones are not opened where their names tell it."""
    if wanted and wanted.sources is not None:
        other = {f"{source}_log.npz" for source in set(range(256)) - wanted.sources}
        archives = [path for path in archives if os.path.basename(path) not in other]
    return _scan(spark, "npzlog", wanted, archives=json.dumps(archives))


def as_packages(wire: DataFrame) -> DataFrame:
    """Entries as stored, with their payload decoded; their place in an archive stays."""
    data: Column = F.col("data")
    place = [c for c in ("place",) if c in wire.columns]
    return wire.select("source_id", "acquisition_time", codec.payload_of(data).alias("serialized_data"), "entry_key", *place)


def write_archives(entries: DataFrame, directory: str, *, verify_integrity: bool = False, tasks: int | None = None) -> list[str]:
    """Entries as stored (WIRE) as one archive for each source in a directory; returns the archives.

    Each source goes to one task in order of time and is streamed to its archive, so no source has to fit in memory.
    An existing archive of a source is replaced, all of them at once when the last is whole. ValueError if the optional check,
    which reads all of them back, found a difference. `entries` are run again for each of these steps.
    """
    spark = entries.sparkSession
    register(spark)
    sources = sorted(row["source_id"] for row in entries.select("source_id").distinct().collect())  # a byte: 256 at most
    if not sources:
        return []
    tasks = min(len(sources), 4 * spark.sparkContext.defaultParallelism) if tasks is None else max(1, tasks)  # by bytes of the shuffle there would be few
    ordered = entries.repartition(tasks, "source_id").sortWithinPartitions("source_id", "acquisition_time", "entry_key")
    ordered.write.format("npzlog").mode("append").save(directory)
    written = sorted(os.path.join(directory, f"{source}_log.npz") for source in sources)
    if verify_integrity:
        bad = mismatches(entries, read_archives(spark, written), "data").select("source_id").first()
        if bad is not None:
            raise ValueError(f"the archive of source {bad['source_id']} in {directory} differs from the entries it was made of")
    return written


def assemble_log_archives(spark: SparkSession, log_directory: str, *, remove_sources: bool = True, verify_integrity: bool = False, tasks: int | None = None) -> list[str]:
    """Consolidate the entry files of a log directory into one archive for each source, as write_archives(); returns the archives.

    The files go only after the optional check found no difference; ValueError if it did.
    """
    entries = read_entries(spark, log_directory)
    written = write_archives(entries, log_directory, verify_integrity=verify_integrity, tasks=tasks)
    if written and remove_sources:

        def remove(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for key in part["entry_key"]:
                    os.unlink(os.path.join(log_directory, f"{key}.npy"))
                yield part

        entries.select("entry_key").mapInPandas(remove, "entry_key string").count()
    return written


def find_log_archive(log_directory: str, source_id: str) -> str:
    """The only archive of a source in or below a directory; FileNotFoundError or ValueError otherwise."""
    if not os.path.isdir(log_directory):
        raise FileNotFoundError(log_directory)
    name = f"{source_id}_log.npz"
    found = sorted(path for path, _, own, _, kind, *_ in walk(log_directory) if own == name and kind == "file")
    if not found:
        raise FileNotFoundError(f"no {name} in {log_directory}")
    if len(found) > 1:
        raise ValueError(f"several {name} in {log_directory}: {found}")
    return found[0]


def discover_log_archives(log_directory: str) -> dict[str, str]:
    """The archives of a directory itself by source id, in order of path."""
    suffix = "_log.npz"
    names = sorted(e.name for e in os.scandir(log_directory) if e.is_file() and e.name.endswith(suffix) and e.name != suffix)
    return {n[: -len(suffix)]: os.path.join(log_directory, n) for n in names}


def archive_message_count(spark: SparkSession, path: str) -> int:
    """Members of an archive that are not onsets, from the names alone."""
    names = read_archive(spark, path, names_only=True)
    return names.filter(~F.col("entry_key").endswith("_" + "0" * 20)).count()
