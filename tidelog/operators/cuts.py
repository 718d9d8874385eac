"""Cuts of long series, drawn from the data: ranges of about equally many rows, however dense a series is anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.runtime import kept

#: Parts of one key at most, and the size of a key's sketch: it is off by about 0.03 % of the key's rows.
GRID, SKETCH = 1024, 16_384
#: Rows of a part.
ROWS = 1 << 20


def cuts(rows: DataFrame, key: str, x: str, most: int = ROWS) -> DataFrame:
    """(key, cuts): for each key with more than `most` rows, the coordinates at which its parts begin, as doubles in order.

    From mergeable quantile sketches, one for each key and task, so the rows are not sorted or moved. There is at most a cut
    for each `most` rows of the input. Sketches draw at random, so the cuts are drawn once and kept. Coordinates that are null or NaN do not count.
    """
    at = F.col(x).cast("double")
    sketched = rows.filter(at.isNotNull() & ~F.isnan(at)).groupBy(F.col(key).alias(key)).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(at, SKETCH).alias("sketch")).filter(F.col("n") > most)
    ranks = F.array(*(F.lit(k / GRID) for k in range(1, GRID)))
    parts = F.least(F.lit(GRID), F.ceil(F.col("n") / most)).cast("int")
    grid = sketched.select(key, parts.alias("parts"), F.kll_sketch_get_quantile_double("sketch", ranks).alias("grid"))
    chosen = F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda k: F.get("grid", F.floor(k * GRID / F.col("parts")).cast("int") - 1))
    return kept(grid.select(key, F.array_distinct(chosen).alias("cuts")))


def with_part(rows: DataFrame, drawn: DataFrame, key: str, x: str, name: str) -> DataFrame:
    """rows with the part that each lies in, from 0; equal coordinates are together. NaN is in the last part, null in the first.

    The cuts are few; Spark broadcasts them where they are small when they are known, and else splits the skewed side.
    """
    few = drawn.select(F.col(key).alias("__cut_key"), F.col("cuts").alias("__cuts"))
    at = F.col(x).cast("double")
    part: Column = F.coalesce(F.size(F.filter("__cuts", lambda c: F.isnan(at) | (c <= at))).cast("long"), F.lit(0).cast("long"))
    joined = rows.join(few, F.col(key).eqNullSafe(F.col("__cut_key")), "left")
    return joined.withColumn(name, F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(part).cast("long")).drop("__cut_key", "__cuts")


def numbered(rows: DataFrame, key: str, x: str, name: str, most: int = ROWS) -> DataFrame:
    """rows with their number, from 1, in order of x within their key; a key of any size is spread over tasks.

    Rows are numbered within their part, and sums over the counts of the parts before give where a part begins.
    """
    parted = with_part(rows, cuts(rows, key, x, most), key, x, "__part")
    counts = parted.groupBy(F.col(key).alias("__k"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__k", "__p", F.coalesce(before, F.lit(0)).alias("__start"))
    own = parted.withColumn(name, F.row_number().over(Window.partitionBy(key, "__part").orderBy(x)))
    met = own.join(starts, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__part") == F.col("__p")))
    return met.withColumn(name, F.col(name) + F.col("__start")).drop("__part", "__k", "__p", "__start")
