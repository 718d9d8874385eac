"""Alignment of click times with purchase values, by user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.align import interpolate
from tidelog.plans.base import micros, query, table

#: Width of the coordinate buckets that long series are cut into: a week.
WEEK = 7 * 86_400_000_000
HOUR = 3_600_000_000
#: Rows of the parts of a single long series, small enough that these tables have several.
PART_ROWS = 1000

_SERIES = """
WITH src AS (SELECT user_id, epoch_us(ts) AS x, value AS v FROM events WHERE event_type = 'purchase'),
tgt AS ({targets}),
ends AS (SELECT user_id, arg_min(v, x) AS first_v FROM src GROUP BY user_id),
nxt AS (SELECT user_id, x, v, lead(x) OVER w AS x1, lead(v) OVER w AS v1 FROM src WINDOW w AS (PARTITION BY user_id ORDER BY x))
"""
_CLICKS = "SELECT event_id, user_id, epoch_us(ts) AS x FROM events WHERE event_type = 'click'"
_GRID = "SELECT user_id, unnest(range(min(epoch_us(ts)) // 3600000000 * 3600000000, max(epoch_us(ts)) // 3600000000 * 3600000000 + 1, 86400000000)) AS x FROM events GROUP BY user_id"
_DISCRETE = "SELECT {columns}, coalesce(s.v, e.first_v) AS v FROM tgt t ASOF LEFT JOIN nxt s ON t.user_id = s.user_id AND t.x >= s.x LEFT JOIN ends e ON t.user_id = e.user_id"
_LINEAR = """SELECT {columns}, CASE WHEN s.x IS NULL THEN e.first_v WHEN s.x1 IS NULL OR s.x = t.x THEN s.v
ELSE (s.v1 - s.v) / (s.x1 - s.x)::DOUBLE * (t.x::DOUBLE - s.x::DOUBLE) + s.v END AS v
FROM tgt t ASOF LEFT JOIN nxt s ON t.user_id = s.user_id AND t.x >= s.x LEFT JOIN ends e ON t.user_id = e.user_id"""


def _sql(targets: str, value: str, columns: str) -> str:
    return _SERIES.format(targets=targets) + value.format(columns=columns)


def _of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.col("event_type") == kind).select("event_id", "user_id", micros("ts").alias("x"), F.col("value").alias("v"))


def _aligned(spark: SparkSession, sf_dir: str, targets: DataFrame, *, discrete: bool) -> DataFrame:
    return interpolate(_of(spark, sf_dir, "purchase"), targets, key="user_id", discrete=discrete, bucket=WEEK, check=False)


def _clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "click").select("event_id", "user_id", "x")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor(micros("ts") / HOUR) * HOUR
    spans = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(hour).alias("a"), F.max(hour).alias("b"))
    return spans.select("user_id", F.explode(F.sequence("a", "b", F.lit(24 * HOUR))).alias("x"))


@query(_sql(_CLICKS, _DISCRETE, "t.event_id, t.user_id, t.x"))
def asof_discrete_click_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, _clicks(spark, sf_dir), discrete=True)


@query(_sql(_CLICKS, _LINEAR, "t.event_id, t.user_id, t.x"))
def interp_linear_click_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, _clicks(spark, sf_dir), discrete=False)


@query(_sql(_GRID, _DISCRETE, "t.user_id, t.x"))
def interp_discrete_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, _grid(spark, sf_dir), discrete=True)


@query(_sql(_GRID, _LINEAR, "t.user_id, t.x"))
def interp_linear_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, _grid(spark, sf_dir), discrete=False)


@query("SELECT event_id, user_id, epoch_us(ts) AS x, value AS v FROM events WHERE event_type = 'purchase'")
def interp_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the source's own coordinates both kinds give the source back."""
    own = _of(spark, sf_dir, "purchase").select("event_id", "user_id", "x")
    return _aligned(spark, sf_dir, own, discrete=False)


#: One series over all users; of purchases at one time, that of the last event counts.
_GLOBAL = """
WITH src AS (SELECT epoch_us(ts) AS x, arg_max(value, event_id) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1),
nxt AS (SELECT x, v, lead(x) OVER (ORDER BY x) AS x1, lead(v) OVER (ORDER BY x) AS v1 FROM src), e AS (SELECT arg_min(v, x) AS first_v FROM src),
tgt AS (SELECT event_id, epoch_us(ts) AS x FROM events WHERE event_type <> 'purchase')
"""


def _whole(spark: SparkSession, sf_dir: str, *, discrete: bool) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.lit(0).alias("k"), micros("ts").alias("x"), F.col("value").alias("v"))
    targets = events.filter("event_type <> 'purchase'").select("event_id", "k", "x")
    return interpolate(events.filter("event_type = 'purchase'"), targets, key="k", discrete=discrete, rows=PART_ROWS, order="event_id", check=False).drop("k")


@query(_GLOBAL + "SELECT t.event_id, t.x, coalesce(s.v, e.first_v) AS v FROM tgt t CROSS JOIN e ASOF LEFT JOIN nxt s ON t.x >= s.x")
def asof_discrete_one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single series, cut where its rows are."""
    return _whole(spark, sf_dir, discrete=True)


@query(_GLOBAL + """SELECT t.event_id, t.x, CASE WHEN s.x IS NULL THEN e.first_v WHEN s.x1 IS NULL OR s.x = t.x THEN s.v
ELSE (s.v1 - s.v) / (s.x1 - s.x)::DOUBLE * (t.x::DOUBLE - s.x::DOUBLE) + s.v END AS v FROM tgt t CROSS JOIN e ASOF LEFT JOIN nxt s ON t.x >= s.x""")
def interp_linear_one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir, discrete=False)


#: Of each user's purchases the first alone, as a series of one point.
_POINT = "SELECT user_id, arg_min(value, ts) AS v FROM events WHERE event_type = 'purchase' GROUP BY user_id"


@query(f"SELECT e.event_id, e.user_id, epoch_us(e.ts) AS x, p.v FROM events e JOIN ({_POINT}) p ON e.user_id = p.user_id WHERE e.event_type = 'click'")
def interp_single_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series of one point is constant."""
    bought = _of(spark, sf_dir, "purchase")
    first = bought.groupBy("user_id").agg(F.min("x").alias("x"), F.min_by("v", "x").alias("v"))
    return interpolate(first, _clicks(spark, sf_dir).join(first.select("user_id"), "user_id", "left_semi"), key="user_id", check=False)


@query("""SELECT user_id, x, CASE WHEN side = 'low' THEN arg_min(value, ts) ELSE arg_max(value, ts) END AS v FROM (
SELECT user_id, ts, value, unnest(['low', 'high']) AS side, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS a, max(epoch_us(ts)) OVER (PARTITION BY user_id) AS b,
CASE WHEN side = 'low' THEN a - 1000 ELSE b + 1000 END AS x FROM events WHERE event_type = 'purchase') GROUP BY user_id, side, x""")
def interp_clamp_low_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before a series its first value, after it the last one."""
    bought = _of(spark, sf_dir, "purchase")
    ends = bought.groupBy("user_id").agg(F.array(F.min("x") - 1000, F.max("x") + 1000).alias("x")).withColumn("x", F.explode("x"))
    return interpolate(bought, ends, key="user_id", bucket=WEEK, check=False)
