"""Long series cut where their rows are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.operators import archive, cuts
from tidelog.operators.align import interpolate

WEEK = 7 * 86_400_000_000


@pytest.fixture(scope="module")
def dense(spark):
    """90 % of one series in a week of ten years, a second one beside it that is short."""
    random = np.random.default_rng(4)
    x = np.concatenate((random.integers(0, WEEK, 18_000), random.integers(0, 520 * WEEK, 2_000)))
    rows = [(1, int(v), float(k)) for k, v in enumerate(x)] + [(2, int(v), -float(k)) for k, v in enumerate(x[:300])]
    return spark.createDataFrame(rows, "k int, x long, v double").cache()


def test_parts_are_even(spark, dense):
    parted = cuts.with_part(dense, cuts.cuts(dense, "k", "x", 1000), "k", "x", "part")
    sizes = [r["count"] for r in parted.filter("k = 1").groupBy("part").count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 2 * np.median(sizes) and sum(sizes) == 20_000
    assert {r.part for r in parted.filter("k = 2").collect()} == {0}
    ranges = parted.filter("k = 1").groupBy("part").agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy("part").collect()
    assert all(a.b < b.a for a, b in zip(ranges, ranges[1:], strict=False))


@pytest.mark.parametrize("discrete", [True, False])
def test_alignment_is_that_without_cuts(spark, dense, discrete):
    nan = float("nan")
    source = dense.select("k", F.col("x").cast("double").alias("x"), "v", F.monotonically_increasing_id().alias("o"))
    targets = source.select("k", (F.col("x") + F.when(F.col("o") % 2 == 0, 500).otherwise(0)).alias("x"), F.col("o").alias("n")).filter("n % 5 = 0")
    odd = spark.createDataFrame([(1, nan, -1), (1, -1e18, -2), (1, 1e18, -3), (3, 5.0, -4), (None, 1.0, -5), (2, None, -6)], "k int, x double, n long")
    targets = targets.unionByName(odd)

    def shown(**how):
        return sorted(map(str, interpolate(source, targets, key="k", discrete=discrete, order="o", **how).collect()))

    assert shown(rows=700) == shown(rows=10**9) == shown()
    with pytest.raises(ValueError, match="bucket or by rows"):
        shown(rows=5, bucket=5.0)


def test_numbers_of_one_long_source(spark):
    random = np.random.default_rng(5)
    times = np.unique(np.concatenate((random.integers(1, 9000, 5000), random.integers(1, 2**40, 3000))))
    frame = spark.createDataFrame([(s, int(t)) for s in (1, None) for t in times] + [(2, 7), (1, 0)], "source_id int, acquisition_time long")
    got = cuts.numbered(frame, "source_id", "acquisition_time", "n", 500).collect()
    assert len(got) == frame.count()
    for source in (1, None):
        own = sorted((r.acquisition_time, r.n) for r in got if r.source_id == source)
        assert [n for _, n in own] == list(range(1, len(own) + 1))
    out = archive.batches(frame.filter("source_id is not null"), workers=2, rows=500).groupBy("source_id", "batch").count().collect()
    size = -(-len(times) // 8)
    assert sorted((r.source_id, r.batch, r["count"]) for r in out) == [(1, k, min(size, len(times) - k * size)) for k in range(8)] + [(2, 0, 1)]
    assert cuts.numbered(frame.limit(0), "source_id", "acquisition_time", "n").count() == 0


def test_one_coordinate_over_and_over(spark):
    frame = spark.range(5000).selectExpr("1 as k", "cast(7 as long) as x", "id as v")
    drawn = cuts.cuts(frame, "k", "x", 100)
    assert drawn.first().cuts == [7.0]
    assert cuts.with_part(frame, drawn, "k", "x", "p").select("p").distinct().count() == 1
