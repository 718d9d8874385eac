"""A registry as a log of transitions against one that is changed in place."""

import threading
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

from tidelog.functions.digest import job_id
from tidelog.operators import transitions
from tidelog.operators.transitions import TransitionLog
from tidelog.schema import JOB


def played(events):
    """The same, one event after the other."""
    jobs = {}
    for k, (job, kind, detail) in enumerate(events):
        if kind == "register":
            jobs.setdefault(job, {"status": 0, "executor_id": None, "error_message": None, "started_at": None, "completed_at": None})
        if kind == "remove":
            jobs.pop(job, None)
        if job not in jobs:
            continue
        own = jobs[job]
        if kind == "start":
            own |= {"status": 1, "executor_id": detail, "error_message": None, "started_at": k, "completed_at": None}
        elif kind == "complete":
            own |= {"status": 2, "error_message": None, "completed_at": k}
        elif kind == "fail":
            own |= {"status": 3, "error_message": detail, "completed_at": k}
        elif kind == "reset":
            own |= {"status": 0, "executor_id": None, "error_message": None, "started_at": None, "completed_at": None}
    return jobs


def shown(frame):
    return {r.job_id: {c: r[c] for c in ("status", "executor_id", "error_message", "started_at", "completed_at")} for r in frame.collect()}


def test_replay(spark):
    random = np.random.default_rng(7)
    kinds = ["register", "start", "complete", "fail", "reset", "remove"]
    events = [(f"j{random.integers(60)}", str(random.choice(kinds, p=[0.3, 0.2, 0.2, 0.15, 0.1, 0.05])), f"d{k}" if k % 3 else None) for k in range(900)]
    rows = [(k, job, kind, "n", "s", d if kind == "start" else None, d if kind == "fail" else None, k) for k, (job, kind, d) in enumerate(events)]
    frame = spark.createDataFrame(rows, f"seq long, {transitions.EVENT}").repartition(5)
    assert shown(transitions.replayed(frame)) == played(events)
    assert transitions.replayed(frame.limit(0)).count() == 0


@pytest.mark.parametrize("snapshots", [False, True])
def test_log(spark, tmp_path, snapshots):
    log = TransitionLog(str(tmp_path))
    random = np.random.default_rng(8)
    jobs = [(f"job{k}", f"s{k}") for k in range(12)]
    assert log.register(jobs[:8]) == [job_id(*j) for j in jobs[:8]]
    events = [(job_id(*j), "register", None) for j in jobs[:8]]
    for k in range(60):
        job, kind, detail = job_id(*jobs[random.integers(12)]), str(random.choice(["start", "complete", "fail", "reset", "register", "remove"])), f"x{k}"
        log.append([{"job_id": job, "kind": kind, "job_name": "again", "specifier": "", "executor_id": detail, "message": detail, "at": k + 8}])
        events.append((job, kind, detail))
        if snapshots and k in (20, 45):
            assert log.snapshot(spark) == k + 2
    got = log.frame(spark)
    assert got.columns == JOB.names
    assert shown(got) == played(events)
    again = TransitionLog(str(tmp_path)).frame(spark)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    order = [r.job_id for r in got.orderBy("ord").collect()]
    assert order == list(played(events))


def test_many_writers_lose_nothing(spark, tmp_path):
    ids = TransitionLog(str(tmp_path)).register([("job", str(k)) for k in range(8)])
    gate = threading.Barrier(8)

    def work(id_):
        log = TransitionLog(str(tmp_path))
        gate.wait()
        for k in range(25):
            log.start(id_, f"e{k}")
            log.fail(id_, f"m{k}") if k % 2 else log.complete(id_)

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(work, ids))
    log = TransitionLog(str(tmp_path))
    assert log.version() == 1 + 8 * 50 and log.events(spark).count() == 8 + 8 * 50
    assert all((r.status, r.executor_id, r.error_message) == (2, "e24", None) for r in log.frame(spark).collect())


def test_what_is_no_transition(spark, tmp_path):
    log = TransitionLog(str(tmp_path))
    for bad in ({"kind": "start"}, {"job_id": "x", "kind": "state"}, {"job_id": "x"}):
        with pytest.raises(ValueError, match="no transition"):
            log.append([bad])
    assert log.version() == 0 and log.frame(spark).count() == 0
    log.start("unknown")
    assert log.frame(spark).count() == 0
