"""Paths as text columns, with / between the parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def depth(path: Column) -> Column:
    return F.size(parts(path))


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ancestor(path: Column, levels: int) -> Column:
    """The path without its last `levels` parts; an error where it has no so many."""
    if levels < 0:
        raise ValueError("levels must not be negative")
    split = F.split(path, "/")
    cut = F.array_join(F.slice(split, F.lit(1), F.greatest(F.size(split) - levels, F.lit(1))), "/")
    return F.when(F.size(split) > levels, cut).otherwise(F.raise_error(F.lit("a path has too few parents")).cast("string"))


def tail(path: Column, count: int = 6) -> Column:
    """The last parts of a path, for messages."""
    split = parts(path)
    return F.array_join(F.slice(split, F.greatest(F.size(split) - count + 1, F.lit(1)), F.lit(count)), "/")


def target(destination: str, rel_path: Column) -> Column:
    return F.concat(F.lit(destination.rstrip("/") + "/"), rel_path)
