"""Discovery and reconciliation, on the paths of pages and the documents with and without labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import paths
from tidelog.operators import discovery
from tidelog.plans.base import query, table

_PATHS = r"WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+:/|[?#].*$', '', 'g') AS path FROM pages), l AS (SELECT page_id, regexp_replace(path, '/+$', '') AS path FROM p)"


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: /host/language/number."""
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+:/|[?#].*$", ""), "/+$", "")
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.withColumn("name", paths.name(F.col("path"))).withColumn("kind", F.lit("file"))


@query(_PATHS + " SELECT page_id, path, (len(list_filter(string_split(path, '/'), lambda x: x <> '')))::INT AS depth FROM l")
def path_depth_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir).select("page_id", "path", paths.depth(F.col("path")).alias("depth")).orderBy("depth", "path")


@query(_PATHS + " SELECT path FROM l WHERE string_split(path, '/')[-1] = (SELECT max(string_split(path, '/')[-1]) FROM l)")
def marker_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = _listed(spark, sf_dir)
    return discovery.marker_files(listing, listing.agg(F.max("name")).scalar())


@query(_PATHS + " SELECT DISTINCT array_to_string(string_split(path, '/')[:-3], '/') AS root FROM l")
def marker_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.marker_roots(_listed(spark, sf_dir), levels_up=1)


@query("""WITH p AS (SELECT c_custkey AS ord, '/data/n' || c_nationkey || '/' || c_name || '/raw' AS path FROM customer)
SELECT min(ord) AS ord, array_to_string(string_split(path, '/')[:-2], '/') AS root FROM p GROUP BY 2""")
def unique_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' folders below their nation's: the name is the deepest part of its own."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.concat(F.lit("/data/n"), F.col("c_nationkey").cast("string"), F.lit("/"), "c_name", F.lit("/raw")).alias("path"))
    return discovery.unique_roots(rows)


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unaccounted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label, as files of a destination that the source does not have."""
    return discovery.unaccounted(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


@query("SELECT conv_id, role, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id, role")
def ordered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a group in order of their ordinal, as archives keep their members."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return rows.withColumn("turns", F.array_join(F.transform("turns", lambda t: t.cast("string")), ","))
