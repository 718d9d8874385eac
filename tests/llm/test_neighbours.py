import math

import numpy as np
from pyspark.sql import functions as F

from tidelog.llm import neighbours
from tidelog.llm.common import table

SF = "/root/testdata/sf0.1"


def brute(ids, vectors, query_id, k=10):
    far = np.sqrt(((vectors - vectors[ids == query_id][0]) ** 2).sum(axis=1))
    far[ids == query_id] = np.inf
    order = np.lexsort((ids, far))[:k]
    return ids[order].tolist(), far[order]


def test_recall(spark):
    rows = table(spark, SF, "embeddings")
    got = neighbours.nearest(rows, F.col("vec_id") % 20 == 0).toPandas().sort_values(["query_id", "rank"])
    own = rows.toPandas().sort_values("vec_id")
    ids, vectors = own.vec_id.to_numpy(), np.array(own.embedding.tolist(), float)
    hits = 0
    for query, found in got.groupby("query_id"):
        want, far = brute(ids, vectors, query)
        hits += len(set(want) & set(found.vec_id))
        assert found["rank"].tolist() == list(range(1, 11))
        assert np.allclose(found.score, np.sqrt(((vectors[np.searchsorted(ids, found.vec_id)] - vectors[ids == query][0]) ** 2).sum(axis=1)))
    assert hits >= 0.95 * len(got)
    assert got.query_id.nunique() == (ids % 20 == 0).sum()


def test_chi_square_bound():
    assert abs(neighbours.chi_square(15.507) - 0.95) < 1e-4  # a table's value for 8 degrees of freedom
    assert abs(neighbours.chi_square(neighbours.bound(0.9)) - 0.9) < 1e-6


def test_ties_copies_and_useless_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [(i, [1.0, 0.0]) for i in range(1, 60)] + [(100, [0.0, 1.0]), (0, [1.0, 0.0]), (200, None), (201, []), (202, [0.0, 0.0]), (203, [nan, 1.0]), (204, [inf, 1.0]), (205, [None, 1.0]), (None, [1.0, 1.0]), (300, [1.0, 2.0, 3.0]), (301, [1.0, 2.0, 4.0])]
    data = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = neighbours.nearest(data, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    by = {q: [(r.vec_id, r.score) for r in got if r.query_id == q] for q in {r.query_id for r in got}}
    assert by[0] == [(i, 0.0) for i in range(1, 11)]
    assert by[100] == [(i, math.sqrt(2)) for i in range(10)]
    assert by[300] == [(301, 1.0)]
    assert set(by) == {0, 100, 300}
    assert neighbours.nearest(data.limit(0), F.lit(True)).count() == 0


def test_parts_and_groups_of_copies_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 8)
    monkeypatch.setattr(neighbours, "TOGETHER", 16)
    random = np.random.default_rng(5)
    vectors = random.integers(-3, 4, (600, 4)).astype(float)
    vectors[::3] = [1, 2, 3, 1]  # a third of all rows
    vectors[(vectors == 0).all(axis=1)] = 1
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(vectors)]
    rows += rows[5:8]  # rows that are there twice
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>, asks int")
    got = neighbours.nearest(data, F.col("asks") == 1).toPandas().sort_values(["query_id", "rank"])
    ids, all_ = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert got.groupby("query_id").size().eq(10).all() and got.query_id.nunique() == 300
    for query, found in got.groupby("query_id"):
        want, far = brute(ids, all_, query)
        assert found.vec_id.tolist() == want
        assert np.allclose(found.score, far)


def test_cells_that_a_query_visits_do_not_grow_with_the_table():
    random = np.random.default_rng(6)
    visits = []
    for clusters in (64, 512):
        vectors = np.repeat(random.standard_normal((clusters, 64)), 64, axis=0) + 0.02 * random.standard_normal((clusters * 64, 64))
        projected = vectors @ neighbours.directions(64)
        cuts = neighbours.Cuts(projected, clusters // 4)
        sizes = np.bincount(cuts.cell(projected), minlength=clusters // 4)
        assert sizes.min() > 128 and sizes.max() < 512
        asked = np.arange(0, len(vectors), len(vectors) // 50)
        mates = vectors.reshape(clusters, 64, 64)[asked // 64]
        far = np.sort(((vectors[asked, None] - mates) ** 2).sum(axis=2), axis=1)[:, 10]
        visits.append(np.mean([(cuts.gaps(p) < neighbours.bound() * f).sum() for p, f in zip(projected[asked], far, strict=True)]))
    assert visits[1] < 2 * visits[0] < 16
