"""Maps whose keys are typed anew, and their entries as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def converted_keys(column: str, convert: Callable[[Column], Column]) -> Column:
    """A map with its keys through `convert`. Two keys that become one are an error of the run, as in Spark by default."""
    return F.transform_keys(column, lambda k, v: convert(k))


def entries(rows: DataFrame, column: str, key: str = "key", value: str = "value") -> DataFrame:
    """A row for each entry of a map; a null or empty map gives none."""
    return rows.select(*(c for c in rows.columns if c != column), F.explode(F.map_entries(column)).alias("__entry")).select(*(c for c in rows.columns if c != column), F.col("__entry.key").alias(key), F.col("__entry.value").alias(value))


def mapped(rows: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """(by, entries): the rows of each group as a map; of equal keys the greatest value. For groups of bounded size."""
    own = rows.groupBy(by, key).agg(F.max(value).alias(value))
    return own.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("entries"))
