"""A registry as a log of transitions, which many writers append to at once; its state is an aggregation over them.

An append takes the next version by making its file, which fails if the version is taken, and then tries the one after
it: no transition is lost and all have one order. A snapshot holds the state up to a version, so that later reads start there.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.digest import job_id
from tidelog.operators.tracker import Status, executor_id
from tidelog.schema import JOB

#: What may happen to a job. `state` stands for all that a snapshot holds of it.
KINDS = ("register", "start", "complete", "fail", "reset", "remove", "state")
EVENT = "job_id string, kind string, job_name string, specifier string, executor_id string, message string, at long"
_ENDS = {"complete": Status.SUCCEEDED, "fail": Status.FAILED}


def replayed(events: DataFrame) -> DataFrame:
    """Events (seq, job_id, kind, job_name, specifier, executor_id, message, at) -> jobs with the columns of JOB.

    seq orders the events and is of any type that compares. A job is there from its first registration after its last removal;
    what comes before that is nothing. Later registrations change nothing. As in the registry, no state forbids a transition:
    a start clears what the last end left, an end keeps the start, a reset clears all. `state` events carry JOB's columns in
    a struct `state` and begin a job's history. Everything is in aggregates that merge, so no job's history is sorted.
    """
    if "state" not in events.columns:
        events = events.withColumn("state", F.lit(None).cast(JOB))
    kind, seq = F.col("kind"), F.col("seq")
    gone = events.filter(kind == "remove").groupBy("job_id").agg(F.max("seq").alias("gone"))
    live = events.filter(kind != "remove").join(gone, "job_id", "left").filter(F.col("gone").isNull() | (seq > F.col("gone")))
    first = live.filter(kind.isin("register", "state")).groupBy("job_id").agg(F.min("seq").alias("first"))
    known = live.join(first, "job_id").filter(seq >= F.col("first"))

    def last(condition: Column, *columns: str) -> Column:
        return F.max_by(F.struct("seq", *columns), F.when(condition, seq))

    begins, ends, resets = kind == "start", kind.isin(*_ENDS), kind == "reset"
    jobs = known.groupBy("job_id").agg(
        F.min("first").alias("first"),
        F.min_by(F.struct("job_name", "specifier", "state"), "seq").alias("own"),
        last(begins, "executor_id", "at").alias("s"), last(ends, "kind", "message", "at").alias("e"), last(resets).alias("r"),
    )
    s, e, r, state = (F.col(c) for c in ("s", "e", "r", "own.state"))
    started = s["seq"].isNotNull() & (r["seq"].isNull() | (s["seq"] > r["seq"]))
    others = F.greatest(s["seq"], r["seq"])
    ended = e["seq"].isNotNull() & (others.isNull() | (e["seq"] > others))
    touched = s["seq"].isNotNull() | r["seq"].isNotNull()
    cleared = F.when(touched, F.lit(None))
    status = reduce(lambda c, k: c.when(ended & (e["kind"] == k), int(_ENDS[k])), _ENDS, F.when(F.lit(False), 0))
    status = status.when(started, int(Status.RUNNING)).when(r["seq"].isNotNull(), int(Status.SCHEDULED)).otherwise(F.coalesce(state["status"], F.lit(int(Status.SCHEDULED))))
    return jobs.select(
        "first", "job_id",
        F.coalesce("own.job_name", state["job_name"]).alias("job_name"), F.coalesce("own.specifier", state["specifier"], F.lit("")).alias("specifier"), status.alias("status"),
        F.when(started, s["executor_id"]).when(r["seq"].isNull(), state["executor_id"]).alias("executor_id"),
        F.when(ended, F.when(e["kind"] == "fail", e["message"])).when(~touched, state["error_message"]).alias("error_message"),
        F.when(started, s["at"]).when(r["seq"].isNull(), state["started_at"]).alias("started_at"),
        F.when(ended, e["at"]).when(~touched, state["completed_at"]).otherwise(cleared).alias("completed_at"),
    )


class TransitionLog:
    """A directory with a file for each append and the snapshots; any number of processes may append and read."""

    def __init__(self, path: str) -> None:
        self.path = path
        os.makedirs(path, exist_ok=True)
        self._next = 1

    def _file(self, version: int) -> str:
        return os.path.join(self.path, f"{version:020d}.json")

    def append(self, events: Sequence[dict]) -> int:
        """Events as dictionaries with job_id, kind and what else EVENT has -> the version under which all of them are there."""
        for event in events:
            if event.get("kind") not in KINDS[:-1] or not event.get("job_id"):
                raise ValueError(f"{event} is no transition of a job")
        now = time.time_ns() // 1000
        part = os.path.join(self.path, f".{uuid.uuid4().hex}")
        with open(part, "w", encoding="utf-8") as file:
            file.writelines(json.dumps({"at": now} | event | {"n": n}) + "\n" for n, event in enumerate(events))
        try:
            while True:
                try:
                    os.link(part, self._file(self._next))
                    return self._next
                except FileExistsError:
                    self._next += 1
        finally:
            os.unlink(part)

    def register(self, jobs: Sequence[tuple[str, str]]) -> list[str]:
        ids = [job_id(*job) for job in jobs]
        self.append([{"job_id": i, "kind": "register", "job_name": name, "specifier": specifier} for i, (name, specifier) in zip(ids, jobs, strict=True)])
        return ids

    def start(self, id_: str, executor: str | None = None) -> int:
        return self.append([{"job_id": id_, "kind": "start", "executor_id": executor or executor_id()}])

    def complete(self, id_: str) -> int:
        return self.append([{"job_id": id_, "kind": "complete"}])

    def fail(self, id_: str, message: str | None = None) -> int:
        return self.append([{"job_id": id_, "kind": "fail", "message": message}])

    def reset(self, ids: Sequence[str]) -> int:
        return self.append([{"job_id": i, "kind": "reset"} for i in ids])

    def _snapshot(self) -> tuple[int, str | None]:
        found = [n for n in os.listdir(self.path) if n.startswith("snapshot-") and os.path.exists(os.path.join(self.path, n, "_SUCCESS"))]
        return max(((int(n[9:]), os.path.join(self.path, n)) for n in found), default=(0, None))

    def events(self, spark: SparkSession, after: int = 0, through: int | None = None) -> DataFrame:
        """Events of the versions after one, with seq (version, place in it)."""
        files = [self._file(v) for v in range(after + 1, (through or self.version()) + 1)]
        if not files:
            return spark.createDataFrame([], f"seq struct<version:long,n:long>, {EVENT}")
        rows = spark.read.schema(f"{EVENT}, n long").json(files).withColumn("version", F.substring(F.col("_metadata.file_name"), 1, 20).cast("long"))
        return rows.select(F.struct("version", "n").alias("seq"), *(c.strip().split()[0] for c in EVENT.split(",")))

    def version(self) -> int:
        """The last version. Versions have no gaps, so the next one is sought from the one known."""
        after, _ = self._snapshot()
        version = max(self._next - 1, after)
        while os.path.exists(self._file(version + 1)):
            version += 1
        return version

    def _state(self, spark: SparkSession, through: int) -> DataFrame:
        after, path = self._snapshot()
        events = self.events(spark, after, through).withColumn("state", F.lit(None).cast(JOB))
        if path:
            nothing = [F.lit(None).cast("string").alias(c) for c in ("job_name", "specifier", "executor_id", "message")]
            held = spark.read.schema(JOB).parquet(path)
            events = held.select(F.struct(F.lit(0).cast("long").alias("version"), F.col("ord").alias("n")).alias("seq"), "job_id", F.lit("state").alias("kind"), *nothing[:4], F.lit(None).cast("long").alias("at"), F.struct(*JOB.names).alias("state")).unionByName(events)
        return replayed(events)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The registry now, with the columns of JOB. `ord` keeps the order of registration and has gaps between versions."""
        rows = self._state(spark, self.version())
        return rows.select(F.when(F.col("first.version") == 0, F.col("first.n")).otherwise(F.col("first.version") * (1 << 32) + F.col("first.n")).alias("ord"), *JOB.names[1:])

    def snapshot(self, spark: SparkSession) -> int:
        """Write the state up to the present version, which is returned."""
        version = self.version()
        self.frame(spark).select(*(F.col(f.name).cast(f.dataType) for f in JOB)).write.mode("overwrite").parquet(os.path.join(self.path, f"snapshot-{version:020d}"))
        return version
