import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import quality
from tidelog.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.learn(docs, labels)
    return docs, labels, model, quality.classify(docs, model).join(labels, "doc_id").toPandas()


def test_held_out_accuracy(scored):
    held = scored[3][scored[3].held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (held.predicted == (held.score >= 0.3)).all()
    assert held.score.between(0, 1).all()


def test_rejected_documents_go(scored):
    docs, _, model, _ = scored
    kept = {r.doc_id for r in quality.classify(docs, model, keep=True).select("doc_id").collect()}
    want = {r.doc_id for r in quality.classify(docs, model).filter("predicted = 1").collect()}
    assert kept == want


@pytest.mark.parametrize("seed", range(6))
def test_pairs_learn_what_single_features_cannot(seed):
    x = np.random.default_rng(seed).random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95
    lone = quality.Model(model.start, model.edges, model.tables, {}, model.coarse)
    assert ((lone.scores(x) > 0.5) == y).mean() < 0.7


def worth(g, h):
    return g.sum() ** 2 / (h.sum() + quality.DAMPING)


@pytest.mark.parametrize("seed", range(5))
def test_cuts_of_a_pair_are_the_best(seed):
    rng = np.random.default_rng(seed)
    g, h = rng.normal(0, 1, (6, 5)), rng.random((6, 5))
    want = max(
        sum(worth(a[rows, part], b[rows, part]) for rows, c in ((slice(0, r), c0), (slice(r, None), c1)) for part in (slice(0, c), slice(c, None)))
        for a, b in ((g, h), (g.T, h.T))
        for r in range(len(a))
        for c0 in range(a.shape[1])
        for c1 in range(a.shape[1])
    )
    gain, step = quality._pair_tree(g, h)
    assert gain == pytest.approx(want - worth(g, h))
    assert len(np.unique(step)) <= 4


def test_scores_are_sums_of_table_entries(scored):
    docs, _, model, _ = scored
    rows = docs.limit(40).toPandas()
    x = quality.features(pa.array(rows.text))
    got = {r.doc_id: r.score for r in quality.classify(docs, model).collect()}
    for k, doc in enumerate(rows.doc_id):
        bins = [sum(v >= e for e in edges) for v, edges in zip(x[k], model.edges, strict=True)]
        total = model.start + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
        total += sum(t[model.coarse[a][bins[a]], model.coarse[b][bins[b]]] for (a, b), t in model.pairs.items())
        assert got[doc] == pytest.approx(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def test_edges_of_the_input(spark):
    rows = [(None, None, "x"), (1, "", "y"), (1, "", "y"), (2, "word " * 300_000, "z"), (3, "\x00 é\n\n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    assert {r.score for r in quality.classify(docs, model).collect()} == {0.5}
    assert quality.classify(docs, model).count() == 5
    assert quality.classify(docs, model, keep=True).columns == docs.columns
    assert quality.classify(docs.limit(0), model).count() == 0
    assert np.isfinite(quality.features(pa.array(["", None, "a"]))).all()
