"""Job registries: orders as jobs, with the priority as the name and the key as the specifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import maps
from tidelog.functions.digest import job_id_of
from tidelog.operators import tracker, transitions
from tidelog.plans.base import micros, query, table
from tidelog.schema import JOB


def _requested(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_orderpriority").alias("job_name"), F.col("o_orderkey").cast("string").alias("specifier"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: F succeeded, P running, O failed for keys divisible by 5 and else scheduled."""
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderkey") % 5 == 0, 3).otherwise(0)
    at = micros("o_orderdate")
    return orders.select(
        F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_orderpriority").alias("job_name"),
        F.col("o_orderkey").cast("string").alias("specifier"), status.alias("status"),
        F.when(status != 0, F.concat(F.lit("pid:"), F.col("o_custkey").cast("string"))).alias("executor_id"), F.when(status == 3, F.lit("lost")).alias("error_message"),
        F.when(status != 0, at).alias("started_at"), F.when(status >= 2, at + 1_000_000).alias("completed_at"), "o_custkey",
    )


_JOBS = """
WITH base AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 0 END END::INT AS status, epoch_us(o_orderdate) AS at_us FROM orders),
jobs AS (SELECT o_orderkey AS ord, o_orderkey::VARCHAR AS job_id, o_orderpriority AS job_name, o_orderkey::VARCHAR AS specifier, status,
  CASE WHEN status <> 0 THEN 'pid:' || o_custkey END AS executor_id, CASE WHEN status = 3 THEN 'lost' END AS error_message,
  CASE WHEN status <> 0 THEN at_us END AS started_at, CASE WHEN status >= 2 THEN at_us + 1000000 END AS completed_at, o_custkey FROM base)
"""
#: Results carry no nulls, so that both engines' clients show them alike.
_SHOWN = "ord, job_id, job_name, specifier, status, coalesce(executor_id, '') AS executor_id, coalesce(error_message, '') AS error_message, coalesce(started_at, -1)::BIGINT AS started_at, coalesce(completed_at, -1)::BIGINT AS completed_at"
_COUNTS = "count(*) AS total, count(*) FILTER (WHERE status = 2) AS succeeded, count(*) FILTER (WHERE status = 3) AS failed, count(*) FILTER (WHERE status = 1) AS running, count(*) FILTER (WHERE status = 0) AS scheduled"
_LABEL = "CASE WHEN failed > 0 THEN 'failed' WHEN total > 0 AND succeeded = total THEN 'completed' WHEN running > 0 THEN 'processing' WHEN total > 0 AND scheduled = total THEN 'not_started' ELSE 'in_progress' END AS label"


def _shown(jobs: DataFrame) -> DataFrame:
    return jobs.select(*JOB.names).fillna("", ["executor_id", "error_message"]).fillna(-1, ["started_at", "completed_at"])


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark, sf_dir).drop("o_custkey")


_NEW = "SELECT o_orderkey AS ord, o_orderkey::VARCHAR AS job_id, o_orderpriority AS job_name, o_orderkey::VARCHAR AS specifier, 0 AS status, NULL AS executor_id, NULL AS error_message, NULL::BIGINT AS started_at, NULL::BIGINT AS completed_at"


@query(_JOBS + f"SELECT {_SHOWN} FROM (SELECT * EXCLUDE (o_custkey) FROM jobs WHERE ord % 3 <> 0 UNION ALL {_NEW} FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0)")
def tracker_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose key 3 does not divide are known; even ones are asked for."""
    return _shown(tracker.added(_jobs(spark, sf_dir).filter("ord % 3 <> 0"), _requested(table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0"))))


@query(_JOBS + f"SELECT {_SHOWN} FROM (SELECT * EXCLUDE (o_custkey) FROM jobs WHERE ord % 3 <> 0 AND ord % 2 = 0 UNION ALL {_NEW} FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 3 = 0)")
def tracker_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return _shown(tracker.aligned(_jobs(spark, sf_dir).filter("ord % 3 <> 0"), _requested(orders.filter("o_orderkey % 4 = 0")), _requested(orders.filter("o_orderkey % 2 = 0"))))


@query(_JOBS + f"SELECT {_SHOWN} FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = j.o_custkey AND c.c_mktsegment = 'BUILDING')")
def tracker_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of customers outside one segment."""
    jobs = registry(spark, sf_dir)
    inside = jobs.join(table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return _shown(tracker.foreign(jobs, inside))


@query(_JOBS + f"SELECT {_SHOWN} FROM jobs WHERE contains(job_name, 'URG') AND contains(specifier, '12')")
def tracker_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(tracker.found(_jobs(spark, sf_dir), "URG", "12"))


@query(_JOBS + f"SELECT {_SHOWN} FROM jobs WHERE status = 3")
def tracker_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(tracker.with_status(_jobs(spark, sf_dir), "FAILED"))


@query(_JOBS + "SELECT s.status::INT AS status, count(j.job_id) AS jobs FROM (SELECT unnest([0, 1, 2, 3]) AS status) s LEFT JOIN (SELECT * FROM jobs WHERE status <> 1) j ON s.status = j.status GROUP BY s.status")
def tracker_summary_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.histogram(_jobs(spark, sf_dir).filter("status <> 1"))


@query(_JOBS + f"SELECT *, {_LABEL} FROM (SELECT o_custkey, {_COUNTS} FROM jobs GROUP BY o_custkey)")
def tracker_status_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.summarized(registry(spark, sf_dir), "o_custkey")


@query(_JOBS + f"SELECT *, {_LABEL} FROM (SELECT {_COUNTS} FROM jobs)")
def tracker_summary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.summarized(_jobs(spark, sf_dir))


@query(_JOBS + "SELECT o_custkey, coalesce(bool_and(status = 2), false) AS complete FROM jobs GROUP BY o_custkey")
def tracker_complete_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.flags(registry(spark, sf_dir), "o_custkey").select("o_custkey", "complete")


@query(_JOBS + "SELECT o_custkey, coalesce(bool_or(status = 3), false) AS error FROM jobs GROUP BY o_custkey")
def tracker_error_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.flags(registry(spark, sf_dir), "o_custkey").select("o_custkey", "error")


@query(_JOBS + f"SELECT *, {_LABEL} FROM (SELECT c_nationkey, {_COUNTS} FROM jobs JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey)")
def tracker_rollup_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' registries rolled up by nation: counts add up, and the label follows from the sums."""
    own = registry(spark, sf_dir).groupBy("o_custkey").agg(*tracker.counts())
    joined = own.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    names = ("total", "succeeded", "failed", "running", "scheduled")
    return joined.groupBy("c_nationkey").agg(*(F.sum(n).alias(n) for n in names)).withColumn("label", tracker.label(*map(F.col, names)))


def _updated_sql(where: str, **changes: str) -> str:
    columns = ("ord", "job_id", "job_name", "specifier", "status", "executor_id", "error_message", "started_at", "completed_at")
    body = ", ".join(f"CASE WHEN {where} THEN {changes[c]} ELSE {c} END AS {c}" if c in changes else c for c in columns)
    return _JOBS + f"SELECT {_SHOWN} FROM (SELECT {body} FROM jobs)"


@query(_updated_sql("status = 0", status="1", executor_id="'pid:1'", error_message="NULL", started_at="7", completed_at="NULL"))
def tracker_start_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(tracker.started(_jobs(spark, sf_dir), F.col("status") == 0, F.lit("pid:1"), F.lit(7)))


@query(_updated_sql("ord % 4 = 1", status="2", error_message="NULL", completed_at="9"))
def tracker_complete_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(tracker.completed(_jobs(spark, sf_dir), F.col("ord") % 4 == 1, F.lit(9)))


@query(_updated_sql("status = 1", status="3", error_message="'gone'", completed_at="9"))
def tracker_fail_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(tracker.failed(_jobs(spark, sf_dir), F.col("status") == 1, F.lit("gone"), F.lit(9)))


_RESET = {"status": "0", "executor_id": "NULL", "error_message": "NULL", "started_at": "NULL", "completed_at": "NULL"}


@query(_updated_sql("status = 3", **_RESET))
def tracker_retry_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(tracker.retried(_jobs(spark, sf_dir)))


@query(_updated_sql("contains(job_name, 'LOW')", **_RESET))
def tracker_reset_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(tracker.reset(_jobs(spark, sf_dir), F.contains("job_name", F.lit("LOW"))))


@query()
def job_id_xxh64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by XXH64 with seed 0, which SQL has no function for."""
    jobs = _jobs(spark, sf_dir)
    return jobs.select("ord", job_id_of(F.col("job_name"), F.col("specifier")).alias("job_id"))


_STEPS = """WITH e AS (SELECT l_orderkey, (epoch_us(l_shipdate), l_linenumber, l_partkey, l_suppkey) AS seq, l_returnflag AS flag, epoch_us(l_shipdate) AS us, 'w' || l_suppkey AS executor, 'part ' || l_partkey AS message FROM lineitem),
j AS (SELECT l_orderkey, max(seq) FILTER (WHERE flag = 'A') AS s, max(seq) FILTER (WHERE flag <> 'A') AS f, arg_max(us, seq) FILTER (WHERE flag = 'A') AS started, arg_max(executor, seq) FILTER (WHERE flag = 'A') AS executor,
  arg_max(us, seq) FILTER (WHERE flag <> 'A') AS ended, arg_max(flag, seq) AS last, arg_max(message, seq) AS message FROM e GROUP BY l_orderkey)
SELECT o_orderkey::VARCHAR AS job_id, o_orderpriority AS job_name, CASE last WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 ELSE 0 END::INT AS status, coalesce(executor, '') AS executor_id,
  CASE WHEN last = 'R' THEN message ELSE '' END AS error_message, coalesce(started, -1)::BIGINT AS started_at, CASE WHEN f IS NOT NULL AND (s IS NULL OR f > s) THEN ended ELSE -1 END::BIGINT AS completed_at
FROM orders LEFT JOIN j ON o_orderkey = l_orderkey"""


@query(_STEPS)
def tracker_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders register as jobs, and each line of an order is a transition, in order of shipping: A starts, N completes, R fails."""
    zero, us = F.lit(0).cast("long"), micros("l_shipdate")
    job, none = F.col("l_orderkey").cast("string"), F.lit(None).cast("string")
    orders = table(spark, sf_dir, "orders").select(F.struct(*(zero.alias(c) for c in "abcd")).alias("seq"), F.col("o_orderkey").cast("string").alias("job_id"), F.lit("register").alias("kind"), F.col("o_orderpriority").alias("job_name"), F.lit("").alias("specifier"), none.alias("executor_id"), none.alias("message"), zero.alias("at"))
    kind = F.when(F.col("l_returnflag") == "A", "start").when(F.col("l_returnflag") == "N", "complete").otherwise("fail")
    lines = table(spark, sf_dir, "lineitem").select(F.struct(us.alias("a"), F.col("l_linenumber").cast("long").alias("b"), F.col("l_partkey").alias("c"), F.col("l_suppkey").alias("d")).alias("seq"), job.alias("job_id"), kind.alias("kind"), none.alias("job_name"), none.alias("specifier"), F.concat(F.lit("w"), F.col("l_suppkey").cast("string")).alias("executor_id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("message"), us.alias("at"))
    return transitions.replayed(orders.unionByName(lines)).select("job_id", "job_name", "status", "executor_id", "error_message", "started_at", "completed_at").fillna("", ["executor_id", "error_message"]).fillna(-1, ["started_at", "completed_at"])


@query("SELECT o_custkey AS customer, printf('%016x', o_orderkey) AS job_id, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END::INT AS status FROM orders")
def jobs_map_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a map from key to state, whose keys become ids; then its entries as rows."""
    status = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), "o_orderkey", status.alias("status"))
    jobs = maps.mapped(orders, "customer", "o_orderkey", "status")
    jobs = jobs.withColumn("entries", maps.converted_keys("entries", lambda k: F.lpad(F.lower(F.hex(k)), 16, "0")))
    return maps.entries(jobs, "entries", "job_id", "status")
