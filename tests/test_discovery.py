"""Listings of deep and wide trees, and the registries in them."""

import os

import pytest
from pyspark.sql import functions as F

from tidelog.operators import discovery, tracker
from tidelog.operators.tracker import ProcessingTracker
from tidelog.sources.tree import walk


@pytest.fixture
def tree(tmp_path):
    deep = tmp_path
    for k in range(60):
        deep = deep / f"d{k}"
        deep.mkdir()
        (deep / ".hidden").write_text(str(k))
    for k in range(80):
        (tmp_path / f"wide{k}" / "in").mkdir(parents=True)
        for j in range(4):
            (tmp_path / f"wide{k}" / "in" / f"{j}.txt").write_text("x" * j)
    os.symlink(tmp_path, tmp_path / "d0" / "loop")
    os.symlink(tmp_path / "none", tmp_path / "dangling")
    return str(tmp_path)


@pytest.mark.parametrize("budgets", [(1, 1), (5, 40), (10**6, 10**6)])
def test_rounds_find_what_a_walk_finds(spark, tree, budgets):
    if budgets == (1, 1):  # a round for each level
        tree = os.path.join(tree, "wide0")
    listing = discovery.walk_directory(spark, tree, first=budgets[0], budget=budgets[1])
    assert sorted(map(tuple, listing.collect())) == sorted(walk(tree))
    assert listing.filter("kind = 'file'").count() == discovery.walk_files(spark, tree).count()


def test_tasks_are_even(spark, tree):
    listing = discovery.walk_directory(spark, tree, first=100, budget=60)
    sizes = sorted(r["count"] for r in listing.groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 100 + 60 and len(sizes) >= 5


def test_errors_go_up(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        discovery.walk_directory(spark, str(tmp_path / "none"))
    (tmp_path / "a").mkdir()
    assert discovery.walk_directory(spark, str(tmp_path / "a")).count() == 0


def test_registries_of_a_tree(spark, tmp_path):
    ids = {}
    for k in range(7):
        (tmp_path / f"s{k}" / "x").mkdir(parents=True)
        own = ProcessingTracker(str(tmp_path / f"s{k}" / "x" / "jobs.yaml"))
        ids[own.file_path] = own.initialize_jobs([("job", str(j)) for j in range(k)])
        for j, id_ in enumerate(ids[own.file_path]):
            own.start_job(id_, "me") if j % 2 else own.fail_job(id_, "why: 'x'")
    (tmp_path / "other.yaml").write_text("no registry")
    got = tracker.scan(spark, str(tmp_path), "jobs.yaml").orderBy("registry", "ord").collect()
    assert {p: i for p, i in ids.items() if i} == {p: [r.job_id for r in got if r.registry == p] for p in {r.registry for r in got}}
    assert {(r.status, r.executor_id, r.error_message, r.completed_at is None) for r in got} == {(1, "me", None, True), (3, None, "why: 'x'", False)}
    with pytest.raises(Exception, match="other.yaml|mapping|registry"):
        tracker.scan(spark, str(tmp_path), "other.yaml").collect()
