"""Reads, slices, masks and comparisons of arrays, on the embeddings."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import arrays
from tidelog.operators.grid import Grid
from tidelog.plans.base import query, table
from tidelog.plans.storage import folder


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))


def _listed(rows: DataFrame, column: str) -> DataFrame:
    """An element each, as an exact double."""
    return rows.select("vec_id", F.posexplode(column).alias("pos", "v"))


_SQL_LISTED = "SELECT vec_id, (unnest(range(len(a))))::INT AS pos, unnest(a) AS v FROM (SELECT vec_id, {} AS a FROM embeddings)"


@query("SELECT vec_id, embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last FROM embeddings")
def array_index_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("vec_id", arrays.item("a", 0).alias("first"), arrays.item("a", -1).alias("last"))


@query(_SQL_LISTED.format("embedding[1:3]::DOUBLE[]") + " UNION ALL " + _SQL_LISTED.format("embedding[-3:-2]::DOUBLE[]").replace("AS pos", "- 3 AS pos"))
def array_slice_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three elements, and the second and third from the end."""
    rows = _rows(spark, sf_dir).select("vec_id", arrays.part("a", 0, 3).alias("head"), arrays.part("a", -3, -1).alias("tail"))
    return _listed(rows, "head").unionByName(_listed(rows, "tail").withColumn("pos", F.col("pos") - 3))


@query(_SQL_LISTED.format("list_transform(embedding::DOUBLE[], lambda v: CASE WHEN v < 0 THEN 0.0::DOUBLE ELSE v END)"))
def array_masked_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(_rows(spark, sf_dir).withColumn("a", arrays.masked("a", lambda v: v < 0, F.lit(0.0))), "a")


@query(_SQL_LISTED.format("list_transform(embedding::DOUBLE[], lambda v: least(greatest(v, -0.1::DOUBLE), 0.1::DOUBLE))"))
def array_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(_rows(spark, sf_dir).withColumn("a", arrays.clipped("a", F.lit(-0.1), F.lit(0.1))), "a")


_MATRIX = "SELECT vec_id AS r, unnest(range(64)) AS c, unnest(embedding::DOUBLE[]) AS value FROM embeddings"


@query(f"""WITH m AS ({_MATRIX}), u AS (SELECT r, c, CASE WHEN r >= 20 AND r < 150 AND c % 2 = 1 THEN value * 2 ELSE value END AS value FROM m)
SELECT (r - 10) // 3 AS i0, c - 5 AS i1, CASE WHEN value < 0 THEN 0 ELSE least(value, 0.25) END AS value FROM u WHERE r >= 10 AND r < 180 AND (r - 10) % 3 = 0 AND c >= 5 AND c < 60""")
def array_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a matrix in blocks, stored; a part of it updated, then a slice of it masked and clipped."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i0"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i1", "value"))
    height = rows.agg(F.max("i0")).first()[0] + 1
    matrix = Grid.of(rows, (height, 64), float, (64, 16)).save(os.path.join(folder(spark), "matrix"))
    matrix = matrix.update((slice(20, 150), slice(1, None, 2)), lambda v: v * 2)
    return matrix[10:180:3, 5:60].where(lambda v: v < 0, 0.0).clip(0, 0.25).elements()


@query("SELECT label, count(*) AS pairs, count(*) FILTER (WHERE embedding = nxt) AS equal FROM (SELECT label, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings) WHERE nxt IS NOT NULL GROUP BY label")
def array_elementwise_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many neighbours in order of id, within a label, are equal element by element."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "embeddings").withColumn("nxt", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).filter("nxt IS NOT NULL")
    return rows.groupBy("label").agg(F.count("*").alias("pairs"), F.count_if(F.col("embedding") == F.col("nxt")).alias("equal"))
