"""Alignment of two irregular series: the last known value, or linear interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.cuts import cuts, with_part


def interpolate(source: DataFrame, targets: DataFrame, *, key: str, x: str = "x", v: str = "v", discrete: bool = False, bucket: float | None = None, rows: int | None = None, order: str | None = None, check: bool = True) -> DataFrame:
    """targets with a column v: the source's value at each coordinate, clamped to the first and last values.

    discrete gives the value at or before a coordinate in the source's own type; otherwise the value is a double on the
    line between the neighbours. Of sources with one coordinate the last in `order` counts. A NaN coordinate has the
    last value when discrete, else NaN. Targets of a key without a source get null. ValueError for an empty source.

    One exchange of both sides on (key, bucket). Long series are cut, so that one key does not fill one task: `bucket` is a
    width of coordinates; `rows` cuts where the data is, into parts of about so many rows of both sides, at the price of
    one more pass. Each part gets its neighbours from a summary with a row for each part. ValueError for both.
    """
    if check and source.isEmpty():
        raise ValueError("the source series is empty")
    if bucket and rows:
        raise ValueError("a series is cut by bucket or by rows")
    kind, columns = source.schema[v].dataType, targets.columns
    at = _bucket(F.col(x).cast("double") / bucket) if bucket else F.lit(0).cast("long")
    if rows:
        drawn = cuts(source.select(key, x).unionByName(targets.select(key, x)), key, x, rows)
        source, targets = (with_part(side, drawn, key, x, "__part") for side in (source, targets))
        at = F.col("__part")
    nothing = F.lit(None)
    point = F.struct(F.col(x).alias("x"), F.col(v).alias("v"))
    ours = source.filter(F.col(x).isNotNull()).select(F.col(key).alias("__k"), at.alias("__b"), F.col(x).alias("__x"), point.alias("__p"), (F.col(order) if order else F.lit(0)).cast("long").alias("__o"), nothing.alias("__row"))
    theirs = targets.select(F.col(key).alias("__k"), at.alias("__b"), F.col(x).alias("__x"), nothing.cast(ours.schema["__p"].dataType).alias("__p"), F.lit(0).cast("long").alias("__o"), F.struct(*(targets[c] for c in columns)).alias("__row"))
    both = ours.withColumn("__row", F.col("__row").cast(theirs.schema["__row"].dataType)).unionByName(theirs)
    is_target = F.col("__row").isNotNull()
    # A frame that looks ahead would be computed anew for each row, so the second one looks back in reverse order.
    back = Window.partitionBy("__k", "__b").orderBy(F.col("__x").asc(), is_target.asc(), F.col("__o").asc()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("__k", "__b").orderBy(F.col("__x").desc(), is_target.desc(), F.col("__o").desc()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__low", F.last("__p", ignorenulls=True).over(back)).withColumn("__high", F.last("__p", ignorenulls=True).over(ahead)).filter(is_target)
    if bucket or rows:
        ends = ours.groupBy("__k", "__b").agg(F.max_by("__p", F.struct("__x", "__o")).alias("last"), F.min_by("__p", F.struct("__x", "__o")).alias("first"))
        everywhere = ends.unionByName(theirs.select("__k", "__b").distinct(), allowMissingColumns=True).groupBy("__k", "__b").agg(F.first("last", ignorenulls=True).alias("last"), F.first("first", ignorenulls=True).alias("first"))
        before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy("__k").orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
        carried = everywhere.select(F.col("__k").alias("__ck"), F.col("__b").alias("__cb"), F.last("last", ignorenulls=True).over(before).alias("__before"), F.last("first", ignorenulls=True).over(after).alias("__after"))
        met = met.join(carried, (met["__k"].eqNullSafe(F.col("__ck"))) & (met["__b"].eqNullSafe(F.col("__cb"))), "left")
        met = met.withColumn("__low", F.coalesce("__low", "__before")).withColumn("__high", F.coalesce("__high", "__after"))
    value = _discrete() if discrete else _line(F.col("__x"))
    return met.select("__row.*", value.cast(kind if discrete else "double").alias(v))


def _bucket(ratio: Column) -> Column:
    """The bucket of a coordinate; what is past all numbers, NaN too, is in the greatest."""
    edge = 1 << 62
    return F.when(F.isnan(ratio) | (ratio >= edge), edge).when(ratio <= -edge, -edge).otherwise(F.floor(F.when(F.abs(ratio) < edge, ratio))).cast("long")


def _discrete() -> Column:
    return F.coalesce("__low.v", "__high.v")


def _line(x: Column) -> Column:
    low, high = F.col("__low"), F.col("__high")
    x0, v0, x1, v1 = (c.cast("double") for c in (low["x"], low["v"], high["x"], high["v"]))
    x = x.cast("double")
    slope = (v1 - v0) / (x1 - x0) * (x - x0) + v0
    return F.when(F.isnan(x), F.lit(float("nan"))).when(low.isNull(), v1).when(high.isNull() | (x0 == x), v0).otherwise(slope)
