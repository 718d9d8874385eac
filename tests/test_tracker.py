import threading

import pytest
from pyspark.sql import functions as F

from tidelog.functions.digest import job_id, job_id_of
from tidelog.operators import tracker
from tidelog.operators.tracker import Label, ProcessingTracker, Status

GOLDEN = {("suite2p_processing", "plane_0"): "cd0547cf71e4ea30", ("suite2p_processing", ""): "ced6b6029ca878f9", ("process_data", "batch_101"): "e30d3e55fffe8b95"}


def test_ids(spark):
    assert {job: job_id(*job) for job in GOLDEN} == GOLDEN
    rows = spark.createDataFrame(list(GOLDEN), "n string, s string").select("n", "s", job_id_of(F.col("n"), F.col("s")).alias("i")).collect()
    assert {(r.n, r.s): r.i for r in rows} == GOLDEN
    for bad in (("a:b", ""), ("a", "b:c")):
        with pytest.raises(ValueError):
            job_id(*bad)


LABELS = [((4, 1, 1, 1, 1), "failed"), ((3, 3, 0, 0, 0), "completed"), ((3, 1, 0, 1, 1), "processing"), ((2, 0, 0, 0, 2), "not_started"), ((3, 2, 0, 0, 1), "in_progress"), ((0, 0, 0, 0, 0), "in_progress")]


def test_labels(spark):
    names = ("total", "succeeded", "failed", "running", "scheduled")
    rows = spark.createDataFrame([c for c, _ in LABELS], ", ".join(f"{n} long" for n in names))
    assert [r[0] for r in rows.select(tracker.label(*map(F.col, names))).collect()] == [w for _, w in LABELS]
    assert [tracker.resolve_status(dict(zip(names, c, strict=True))).value for c, _ in LABELS] == [w for _, w in LABELS]
    assert tracker.resolve_status({}) is Label.IN_PROGRESS


@pytest.fixture
def store(tmp_path):
    return ProcessingTracker(str(tmp_path / "tracker.yaml"))


def test_life_of_a_job(store, tmp_path, monkeypatch):
    assert store.snapshot() == {} and not (tmp_path / "tracker.yaml").exists()
    a, b = store.initialize_jobs([("x", "1"), ("x", "2")])
    assert store.initialize_jobs([("x", "2"), ("x", "2")]) == [b, b]
    monkeypatch.setenv("SLURM_JOB_ID", "77")
    store.start_job(a)
    assert store.get_job_info(a).executor_id == "slurm:77" and store.get_job_status(a) is Status.RUNNING
    store.fail_job(a, "broken")
    assert store.encountered_error and not store.complete
    assert store.summarize()["status"] == "failed" and store.summarize()["jobs"][0]["error_message"] == "broken"
    assert "error_message" not in store.summarize()["jobs"][1]
    assert store.retry_failed_jobs() == [a] and store.get_jobs_by_status("SCHEDULED") == [a, b]
    with pytest.raises(RuntimeError), store.run_job(a):
        raise RuntimeError("no")
    assert store.get_job_info(a).error_message == "no"
    with pytest.raises(KeyboardInterrupt), store.run_job(a):
        raise KeyboardInterrupt
    assert store.get_job_status(a) is Status.RUNNING
    for id_ in (a, b):
        with store.run_job(id_):
            pass
    assert store.complete and store.get_summary()[Status.SUCCEEDED] == 2
    assert store.find_jobs("x", "2") == {b: ("x", "2")} and store.find_jobs("X") == {}
    with pytest.raises(ValueError):
        store.reset_jobs([a, "none"])
    assert store.complete
    with pytest.raises(ValueError):
        store.get_job_status("none")
    with pytest.raises(KeyError):
        store.get_jobs_by_status("NONE")
    assert ProcessingTracker.discover(str(tmp_path), "tracker.yaml")[0].snapshot().keys() == {a, b}
    store.reset()
    assert store.snapshot() == {}


def test_align(store):
    old, kept = store.initialize_jobs([("a", ""), ("b", "")])
    store.complete_job(kept)
    assert store.align_jobs([("b", ""), ("c", "")]) == [kept, job_id("c")]
    assert list(store.snapshot()) == [kept, job_id("c")] and store.get_job_status(kept) is Status.SUCCEEDED
    for bad in (([], None), ([("d", "")], [("c", "")])):
        with pytest.raises(ValueError):
            store.align_jobs(*bad)
    assert store.resolve_job(old, [("a", "")]) == ("a", "")
    with pytest.raises(ValueError):
        store.resolve_job("none", [("a", "")])


def test_writers_at_the_same_time(store):
    threads = [threading.Thread(target=lambda k=k: store.initialize_jobs([(f"job{k}", str(i)) for i in range(3)])) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(store.snapshot()) == 18


def test_frames(spark, store):
    ids = store.initialize_jobs([("a", "1"), ("a", "2"), ("b", "")])
    store.fail_job(ids[1], "x")
    jobs = store.frame(spark)
    assert [r.job_id for r in jobs.orderBy("ord").collect()] == ids
    assert {r.status: r.jobs for r in tracker.histogram(jobs).collect()} == {0: 2, 1: 0, 2: 0, 3: 1}
    assert tracker.retried(jobs).filter("status = 0 AND error_message IS NULL").count() == 3
    assert tracker.flags(jobs.limit(0)).first().complete is False
    empty = tracker.summarized(jobs.limit(0)).first()
    assert (empty.total, empty.label) == (0, "in_progress")
    requested = jobs.select("ord", "job_id", "job_name", "specifier")
    with pytest.raises(ValueError):
        tracker.aligned(jobs, requested.limit(0))
    with pytest.raises(ValueError):
        tracker.aligned(jobs, requested, requested.limit(1))
