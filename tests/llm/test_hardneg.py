import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import hardneg, registry
from tidelog.llm.common import table

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, k=5):
    """rows: distinct (id, label, integers)."""
    out = []
    for i, label, v in rows:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in rows if j != i and len(w) == len(v))
        for minus, j, _ in [s for s in scored if s[2] == label][:k]:
            inside = [s for s in scored if s[2] != label and 80 * -minus <= 100 * -s[0] <= 100 * -minus]
            out += [(i, j, rank + 1, n, -minus, -s) for rank, (s, n, _) in enumerate(inside[:k])]
    return sorted(out)


def shown(frame):
    return sorted(tuple(r) for r in frame.select(COLUMNS).collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    embeddings = table(spark, sf_dir, "embeddings").toArrow()  # noqa: F841
    want = duckdb.sql(f"SELECT {', '.join(COLUMNS)} FROM ({registry.ORACLE_SQL['op11_hardneg']})").fetchall()
    assert want and shown(registry.op11_hardneg(spark, sf_dir)) == sorted(want)


def test_ties_hot_labels_and_shards_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "SHARD", 64)
    monkeypatch.setattr(hardneg, "CHUNK", 16)
    monkeypatch.setattr(hardneg, "TOGETHER", 3)
    random = np.random.default_rng(3)
    vectors = random.integers(-2, 4, (1500, 5)) / 256
    vectors[::3] = np.array([3, 1, 2, -1, 2]) / 256  # a third of all rows, and of one label
    labels = random.integers(0, 4, 1500)
    labels[::3] = 1
    rows = [(i, int(label), v.tolist()) for i, (label, v) in enumerate(zip(labels, vectors, strict=True))]
    data = spark.createDataFrame(rows + rows[:50], "vec_id long, label int, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("score", F.lit(1))
    got = hardneg.hard_negatives(data, F.col("vec_id") % 100 == 0)
    assert shown(got) == brute([(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows])


def test_rows_that_take_no_part_lengths_and_shared_ids(spark):
    nan, inf = math.nan, math.inf
    good = [(0, 1, [1.0, 0.5]), (100, 1, [0.5, 0.5]), (1, 1, [1.0, 1.0]), (2, 2, [1.0, 0.9]), (3, 2, [0.9, 0.8]), (4, 2, [-1.0, -1.0]), (1, 2, [0.7, 0.9]), (200, 3, [0.0, 0.0]), (5, 3, [0.0, 0.0]), (300, 4, [1.0]), (6, 4, [2.0]), (7, 5, [1.9]), (400, 6, []), (8, 6, []), (9, 7, [])]
    bad = [(10, None, [1.0, 1.0]), (11, 2, None), (12, 2, [nan, 1.0]), (13, 2, [inf, 1.0]), (14, 2, [None, 1.0]), (None, 2, [1.0, 0.9]), (500, 2, [-inf, 1.0])]
    data = spark.createDataFrame(good + bad + good, "vec_id long, label long, embedding array<double>")
    got = hardneg.hard_negatives(data, F.col("vec_id") % 100 == 0)
    assert shown(got) == brute([(i, label, [math.floor(256 * x) for x in v]) for i, label, v in good])
    assert {r[0] for r in shown(got)} == {0, 100, 200, 300, 400}
    assert got.schema["anchor_id"].dataType.simpleString() == "bigint" and got.schema["rank"].dataType.simpleString() == "int"
    assert hardneg.hard_negatives(data.limit(0), F.lit(True)).count() == 0
    with pytest.raises(Exception, match="overflow|OVERFLOW"):
        hardneg.hard_negatives(spark.createDataFrame([(0, 1, [1e9])], "vec_id long, label long, embedding array<double>"), F.lit(True)).collect()


def test_bounds_hold_and_leave_little():
    random = np.random.default_rng(8)
    vectors = random.standard_normal((4000, 33))
    codes = np.floor(256 * vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.int64)
    books = hardneg.fit(codes[:1000])
    words, rest = hardneg.encode(codes, books)
    held = pa.table({"id": np.arange(4000), "label": np.zeros(4000, np.int64), "code": hardneg._blobs(codes.astype(np.int32)), "words": hardneg._blobs(words), "rest": hardneg._blobs(rest)})
    shard = hardneg.Shard(held, books)
    true = codes @ codes[:20].T
    wide = 0
    for own, low, high in shard.bounds(codes[:20]):
        assert (low <= true[own]).all() and (true[own] <= high).all()
        wide += (high >= np.sort(true, axis=0)[-6]).sum()
    assert wide < 0.1 * true.size  # of all products, those that the bound for six neighbours leaves


def test_reruns_agree(spark):
    data = table(spark, "/root/testdata/sf0.01", "embeddings")
    runs = [shown(hardneg.hard_negatives(data.orderBy(F.rand(seed)), F.col("vec_id") % 100 == 0)) for seed in (1, 2)]
    assert runs[0] == runs[1]


@pytest.mark.parametrize("chunk", [5, 64, 8192])
def test_chunks_of_a_shard_change_nothing(monkeypatch, chunk):
    """Thresholds are carried from chunk to chunk; what is cut off can't be among the first."""
    monkeypatch.setattr(hardneg, "CHUNK", chunk)
    random = np.random.default_rng(chunk)
    codes = random.integers(-9, 10, (300, 7))
    codes[::4] = codes[0]  # ties
    ids, labels = random.permutation(300), random.integers(0, 3, 300)
    books = hardneg.fit(codes[:40])
    words, rest = hardneg.encode(codes, books)
    shard = hardneg.Shard(pa.table({"id": ids, "label": labels, "code": hardneg._blobs(codes.astype(np.int32)), "words": hardneg._blobs(words), "rest": hardneg._blobs(rest)}), books)
    rows = sorted(zip(ids.tolist(), labels.tolist(), codes.tolist(), strict=True))
    asked = [r for r in rows if r[0] % 30 == 0]
    anchors = {"id": np.array([r[0] for r in asked]), "label": np.array([r[1] for r in asked]), "key": np.arange(len(asked)), "code": np.array([r[2] for r in asked])}

    def first(scored):
        return [(j, s) for s, j in sorted((-s, j) for j, s in scored)[:5]]

    def product(one, two):
        return sum(a * b for a, b in zip(one, two, strict=True))

    near = {k: first([(j, product(a[2], v)) for j, label, v in rows if label == a[1] and j != a[0]]) for k, a in enumerate(asked)}
    got = hardneg.positives(shard, anchors, 5).to_pylist()
    assert sorted((r["key"], -r["score"], r["other"]) for r in got) == sorted((k, s, j) for k, own in near.items() for j, s in own)
    scores = np.array([[-s for _, s in near[k]] for k in range(len(asked))])
    anchors |= {"low": -(-80 * scores // 100), "high": scores}
    got = hardneg.negatives(shard, anchors, 5).to_pylist()
    want = []
    for k, a in enumerate(asked):
        others = [(j, product(a[2], v)) for j, label, v in rows if label != a[1]]
        for w, p in enumerate(scores[k].tolist()):
            want += [(k, w, s, j) for j, s in first([(j, n) for j, n in others if 80 * p <= 100 * n <= 100 * p])]
    assert sorted((r["key"], r["place"], -r["score"], r["other"]) for r in got) == sorted(want)
