import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.operators.align import interpolate


def run(spark, xs, vs, targets, *, discrete, kind="double", bucket=None, x_kind="double"):
    source = spark.createDataFrame([("k", x, v, i) for i, (x, v) in enumerate(zip(xs, vs, strict=True))], f"k string, x {x_kind}, v {kind}, i int")
    wanted = spark.createDataFrame([("k", float(t) if x_kind == "double" else t, n) for n, t in enumerate(targets)], f"k string, x {x_kind}, n int")
    out = interpolate(source, wanted, key="k", discrete=discrete, bucket=bucket, order="i").orderBy("n")
    return [r.v for r in out.collect()], out.schema["v"].dataType.simpleString()


CASES = [
    ([0, 1, 2, 3, 4], [10, 20, 30, 40, 50], [0.5, 1.5, 2.5, 3.5], True, [10, 20, 30, 40]),
    ([1, 2, 3], [100, 200, 300], [-1, 0, 0.5], True, [100, 100, 100]),
    ([1, 2, 3], [100, 200, 300], [3.5, 4, 10], True, [300, 300, 300]),
    ([0, 1, 2, 3], [10, 20, 30, 40], [0, 1, 2, 3], True, [10, 20, 30, 40]),
    ([1, 2, 3, 4], [10, 20, 30, 40], [0, 1.5, 2.5, 5], True, [10, 10, 20, 40]),
    ([0, 1, 2], [0, 10, 20], [0.5, 1.5], False, [5, 15]),
    ([1, 2, 3], [10, 20, 30], [0, 4], False, [10, 30]),
    ([1], [42], [0, 1, 2], True, [42, 42, 42]),
    ([1], [42], [0, 1, 2], False, [42, 42, 42]),
    ([0, 100, 200, 300, 400], [10, 20, 15, 25, 30], [50, 150, 250, 350], False, [15, 17.5, 20, 27.5]),
    ([0, 1, 2], [10, 20, 30], [], True, []),
]


@pytest.mark.parametrize("bucket", [None, 1.0, 7.0])
@pytest.mark.parametrize("case", CASES)
def test_known_series(spark, case, bucket):
    xs, vs, targets, discrete, want = case
    got, kind = run(spark, list(map(float, xs)), vs, targets, discrete=discrete, kind="int", bucket=bucket)
    assert got == want
    assert kind == ("int" if discrete else "double")


def test_ties_nan_and_empty_sources(spark):
    assert run(spark, [1.0, 1.0, 2.0], [5.0, 6.0, 9.0], [1, 1.5], discrete=True)[0] == [6.0, 6.0]
    assert run(spark, [1.0, 1.0, 2.0], [5.0, 6.0, 9.0], [0, 1, 1.5], discrete=False)[0] == np.interp([0, 1, 1.5], [1, 1, 2], [5, 6, 9]).tolist()
    assert run(spark, [1.0, 2.0], [5.0, 6.0], [math.nan], discrete=True)[0] == [6.0]
    assert math.isnan(run(spark, [1.0, 2.0], [5.0, 6.0], [math.nan], discrete=False)[0][0])
    beyond = [math.nan, math.inf, -math.inf, 1e300, -1e300]
    assert run(spark, [1.0, 250.0], [5.0, 99.0], beyond, discrete=True, bucket=10.0)[0] == [99.0, 99.0, 5.0, 99.0, 5.0]
    with pytest.raises(ValueError):
        run(spark, [], [], [1.0], discrete=True)


@settings(max_examples=8, deadline=None)
@given(st.data())
def test_same_as_numpy(spark, data):
    number = st.floats(-1e6, 1e6, allow_nan=False)
    xs = sorted(data.draw(st.lists(number, min_size=1, max_size=20, unique=True)))
    vs = data.draw(st.lists(number, min_size=len(xs), max_size=len(xs)))
    targets = data.draw(st.lists(number | st.just(math.nan) if len(xs) > 1 else number, max_size=20)) + xs
    bucket = data.draw(st.sampled_from([None, 1e3, 1e5, 1e7]))
    linear = run(spark, xs, vs, targets, discrete=False, bucket=bucket)[0]
    assert np.allclose(linear, np.interp(targets, xs, vs), rtol=1e-9, atol=1e-9, equal_nan=True)
    places = np.clip(np.searchsorted(xs, targets, side="right") - 1, 0, len(xs) - 1)
    assert run(spark, xs, vs, targets, discrete=True, bucket=bucket)[0] == np.array(vs)[places].tolist()


def test_partition_counts_do_not_matter(spark):
    source = spark.range(300).selectExpr("id % 7 as k", "id as x", "id * 2 as v")
    targets = spark.range(150).selectExpr("id % 9 as k", "id * 2 + 1 as x")
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(str(sorted(map(tuple, interpolate(source, targets, key="k", bucket=20).collect()), key=str)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1
