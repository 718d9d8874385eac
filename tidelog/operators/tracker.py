"""Job registries: set algebra, updates and summaries on DataFrames, and a locked YAML file that holds one registry."""

from __future__ import annotations

import fcntl
import os
import time
import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from enum import IntEnum, StrEnum

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidelog.functions.digest import job_id
from tidelog.operators import discovery
from tidelog.operators.config import YamlConfig
from tidelog.runtime import ship
from tidelog.schema import JOB
from tidelog.sources.tree import walk

LOCK_SECONDS = 10


class Status(IntEnum):
    """States of a job; fixed values of the stored format."""

    SCHEDULED = 0
    RUNNING = 1
    SUCCEEDED = 2
    FAILED = 3


class Label(StrEnum):
    """States of a registry; fixed values of the format of summaries."""

    NOT_STARTED = "not_started"
    PROCESSING = "processing"
    IN_PROGRESS = "in_progress"
    COMPLETED = "completed"
    FAILED = "failed"


#: Environment variables that name the job of a cluster's scheduler, in order: the prefix of the id, the variable, and one
#: that must be there beside it. Fixed values.
SCHEDULERS = (
    ("slurm", "SLURM_JOB_ID", None),
    ("slurm", "SLURM_JOBID", None),
    ("pbs", "PBS_JOBID", None),
    ("lsf", "LSB_JOBID", None),
    ("oar", "OAR_JOB_ID", None),
    ("sge", "JOB_ID", "SGE_ROOT"),
    ("hpcpack", "CCP_JOBID", None),
    ("azurebatch", "AZ_BATCH_JOB_ID", None),
    ("awsbatch", "AWS_BATCH_JOB_ID", None),
)


def executor_id() -> str:
    """scheduler:job of the first scheduler that the environment names, or pid:process."""
    named = (f"{prefix}:{os.environ[name]}" for prefix, name, beside in SCHEDULERS if os.environ.get(name) and (beside is None or beside in os.environ))
    return next(named, f"pid:{os.getpid()}")


# --- Registries as DataFrames with the columns of JOB ---


def scheduled(requested: DataFrame) -> DataFrame:
    """Requested jobs (ord, job_id, job_name, specifier) as fresh rows; of equal ids the first in order."""
    first = requested.groupBy("job_id").agg(F.min_by(F.struct("ord", "job_name", "specifier"), "ord").alias("r"))
    nothing = {"executor_id": "string", "error_message": "string", "started_at": "long", "completed_at": "long"}
    return first.select("r.ord", "job_id", "r.job_name", "r.specifier", F.lit(int(Status.SCHEDULED)).alias("status"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))


def added(jobs: DataFrame, requested: DataFrame) -> DataFrame:
    """Register: known jobs stay as they are, new ones follow as scheduled."""
    return jobs.unionByName(scheduled(requested.join(jobs, "job_id", "left_anti")))


def aligned(jobs: DataFrame, requested: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Register, and let go of jobs outside the universe (by default, what is requested).

    ValueError if nothing is requested or something outside the universe is.
    """
    universe = requested if universe is None else universe
    if requested.isEmpty():
        raise ValueError("no jobs are requested")
    if not requested.join(universe, "job_id", "left_anti").isEmpty():
        raise ValueError("a requested job is not in the universe")
    return added(jobs.join(universe, "job_id", "left_semi"), requested)


def foreign(jobs: DataFrame, universe: DataFrame) -> DataFrame:
    return jobs.join(universe, "job_id", "left_anti")


def found(jobs: DataFrame, job_name: str | None = None, specifier: str | None = None) -> DataFrame:
    """Jobs whose name and specifier contain the texts, upper and lower case told apart; None is any."""
    for column, part in (("job_name", job_name), ("specifier", specifier)):
        if part is not None:
            jobs = jobs.filter(F.contains(F.coalesce(column, F.lit("")), F.lit(part)))
    return jobs


def with_status(jobs: DataFrame, status: Status | str) -> DataFrame:
    """KeyError for an unknown name."""
    return jobs.filter(F.col("status") == int(Status[status] if isinstance(status, str) else status))


def _updated(jobs: DataFrame, chosen: Column, changes: dict[str, Column]) -> DataFrame:
    return jobs.select(*(F.when(chosen, changes[c].cast(jobs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in jobs.columns))


def started(jobs: DataFrame, chosen: Column, executor: Column, now: Column) -> DataFrame:
    return _updated(jobs, chosen, {"status": F.lit(int(Status.RUNNING)), "executor_id": executor, "error_message": F.lit(None), "started_at": now, "completed_at": F.lit(None)})


def completed(jobs: DataFrame, chosen: Column, now: Column) -> DataFrame:
    return _updated(jobs, chosen, {"status": F.lit(int(Status.SUCCEEDED)), "error_message": F.lit(None), "completed_at": now})


def failed(jobs: DataFrame, chosen: Column, message: Column, now: Column) -> DataFrame:
    return _updated(jobs, chosen, {"status": F.lit(int(Status.FAILED)), "error_message": message, "completed_at": now})


def reset(jobs: DataFrame, chosen: Column) -> DataFrame:
    nothing = F.lit(None)
    return _updated(jobs, chosen, {"status": F.lit(int(Status.SCHEDULED)), "executor_id": nothing, "error_message": nothing, "started_at": nothing, "completed_at": nothing})


def retried(jobs: DataFrame) -> DataFrame:
    return reset(jobs, F.col("status") == int(Status.FAILED))


def counts() -> list[Column]:
    """Aggregates: how many jobs there are, and how many in each state."""
    each = (("succeeded", Status.SUCCEEDED), ("failed", Status.FAILED), ("running", Status.RUNNING), ("scheduled", Status.SCHEDULED))
    return [F.count("*").alias("total"), *(F.count_if(F.col("status") == int(s)).alias(n) for n, s in each)]


def label(total: Column, succeeded: Column, failed_: Column, running: Column, scheduled_: Column) -> Column:
    """A registry's label from its counts; the first rule that holds decides, and a null counts as 0."""
    total, succeeded, failed_, running, scheduled_ = (F.coalesce(c, F.lit(0)) for c in (total, succeeded, failed_, running, scheduled_))
    some = total > 0
    return (
        F.when(failed_ > 0, Label.FAILED.value)
        .when(some & (succeeded == total), Label.COMPLETED.value)
        .when(running > 0, Label.PROCESSING.value)
        .when(some & (scheduled_ == total), Label.NOT_STARTED.value)
        .otherwise(Label.IN_PROGRESS.value)
    )


def summarized(jobs: DataFrame, *by: str) -> DataFrame:
    """Counts and label of each group, or of all jobs; rolls up registries when grouped by their place."""
    own = label(*(F.col(c) for c in ("total", "succeeded", "failed", "running", "scheduled")))
    return jobs.groupBy(*by).agg(*counts()).withColumn("label", own)


def flags(jobs: DataFrame, *by: str) -> DataFrame:
    """complete: there are jobs and all succeeded. error: some failed."""
    ok = F.coalesce(F.every(F.col("status") == int(Status.SUCCEEDED)), F.lit(False))
    return jobs.groupBy(*by).agg(ok.alias("complete"), F.coalesce(F.some(F.col("status") == int(Status.FAILED)), F.lit(False)).alias("error"))


def histogram(jobs: DataFrame) -> DataFrame:
    """How many jobs are in each state, those with none too: (status, jobs)."""
    spark = jobs.sparkSession
    states = spark.range(len(Status)).select(F.col("id").cast("int").alias("status"))
    return states.join(jobs.groupBy("status").agg(F.count("*").alias("jobs")), "status", "left").fillna(0, ["jobs"])


# --- One registry in a file ---


@dataclass
class JobState:
    job_name: str
    specifier: str = ""
    status: int = int(Status.SCHEDULED)
    executor_id: str | None = None
    error_message: str | None = None
    started_at: int | None = None
    completed_at: int | None = None


@dataclass
class Registry(YamlConfig):
    """What a registry's file holds."""

    jobs: dict[str, JobState] = field(default_factory=dict)


def _now() -> int:
    return time.time_ns() // 1000


class ProcessingTracker:
    """A registry in a YAML file that processes on hosts with one file system share; each change holds the file's lock.

    Reading never makes the file. A wait of more than LOCK_SECONDS for the lock is a TimeoutError.
    """

    def __init__(self, file_path: str) -> None:
        self.file_path = os.fspath(file_path)

    @classmethod
    def discover(cls, root: str, name: str) -> list[ProcessingTracker]:
        """The registries with this file name below a directory, in order of path. A directory that can't be read is an error."""
        return [cls(path) for path, _, own, _, kind, *_ in sorted(walk(root)) if own == name and kind == "file"]

    @contextmanager
    def _locked(self, *, write: bool) -> Iterator[dict[str, JobState]]:
        if not write and not os.path.exists(self.file_path):
            yield {}
            return
        with open(self.file_path + ".lock", "a") as lock:
            until = time.monotonic() + LOCK_SECONDS
            while True:
                try:
                    fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    break
                except BlockingIOError:
                    if time.monotonic() > until:
                        raise TimeoutError(f"{self.file_path} is locked") from None
                    time.sleep(0.02)
            store = Registry.from_yaml(self.file_path) if os.path.exists(self.file_path) else Registry()
            yield store.jobs
            if write:
                store.to_yaml(self.file_path)

    @staticmethod
    def _ids(jobs: list[tuple[str, str]]) -> list[str]:
        return [job_id(*job) for job in jobs]

    def initialize_jobs(self, jobs: list[tuple[str, str]]) -> list[str]:
        """Add jobs that are not there; the ids of all that were given."""
        with self._locked(write=True) as known:
            for id_, job in zip(self._ids(jobs), jobs, strict=True):
                if id_ in known:
                    warnings.warn(f"the job {':'.join(job)} ({id_}) is there already and stays as it is", stacklevel=3)
                known.setdefault(id_, JobState(*job))
        return self._ids(jobs)

    def align_jobs(self, jobs: list[tuple[str, str]], universe: list[tuple[str, str]] | None = None) -> list[str]:
        """Add jobs and let go of those outside the universe. ValueError if none are given or one is outside."""
        wanted, all_ = self._ids(jobs), set(self._ids(universe if universe is not None else jobs))
        if not wanted or not set(wanted) <= all_:
            raise ValueError("jobs must be given, and be in the universe")
        with self._locked(write=True) as known:
            gone = sorted(set(known) - all_)
            if gone:
                warnings.warn(f"{self.file_path} lets go of jobs outside the universe: {gone}", stacklevel=3)
            for id_ in gone:
                del known[id_]
            for id_, job in zip(wanted, jobs, strict=True):
                known.setdefault(id_, JobState(*job))
        return wanted

    @staticmethod
    def resolve_job(id_: str, universe: list[tuple[str, str]]) -> tuple[str, str]:
        for job in universe:
            if job_id(*job) == id_:
                return job
        raise ValueError(f"no job has the id {id_}")

    @staticmethod
    def _one(known: dict[str, JobState], id_: str) -> JobState:
        if id_ not in known:
            raise ValueError(f"no job has the id {id_}; there are {sorted(known)}")
        return known[id_]

    def start_job(self, id_: str, executor: str | None = None) -> None:
        with self._locked(write=True) as known:
            job = self._one(known, id_)
            job.status, job.executor_id, job.error_message = int(Status.RUNNING), executor or executor_id(), None
            job.started_at, job.completed_at = _now(), None

    def complete_job(self, id_: str) -> None:
        with self._locked(write=True) as known:
            job = self._one(known, id_)
            job.status, job.error_message, job.completed_at = int(Status.SUCCEEDED), None, _now()

    def fail_job(self, id_: str, error_message: str | None = None) -> None:
        with self._locked(write=True) as known:
            job = self._one(known, id_)
            job.status, job.error_message, job.completed_at = int(Status.FAILED), error_message, _now()

    @contextmanager
    def run_job(self, id_: str, executor: str | None = None) -> Iterator[None]:
        """Start, then complete or fail. An error that is no Exception leaves the job running."""
        self.start_job(id_, executor)
        try:
            yield
        except Exception as error:
            self.fail_job(id_, str(error))
            raise
        self.complete_job(id_)

    def reset_jobs(self, ids: list[str]) -> list[str]:
        """Schedule jobs anew, all or none; their ids in order of registration."""
        with self._locked(write=True) as known:
            if missing := sorted(set(ids) - set(known)):
                raise ValueError(f"no jobs have the ids {missing}")
            for id_ in ids:
                known[id_] = JobState(known[id_].job_name, known[id_].specifier)
            return [i for i in known if i in set(ids)]

    def retry_failed_jobs(self) -> list[str]:
        return self.reset_jobs(self.get_jobs_by_status(Status.FAILED))

    def reset(self) -> None:
        with self._locked(write=True) as known:
            known.clear()

    def snapshot(self) -> dict[str, JobState]:
        with self._locked(write=False) as known:
            return dict(known)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The registry as a DataFrame with the columns of JOB."""
        rows = [(k, i, *(asdict(j)[c] for c in JOB.names[2:])) for k, (i, j) in enumerate(self.snapshot().items())]
        return spark.createDataFrame(rows, JOB)

    def find_jobs(self, job_name: str | None = None, specifier: str | None = None) -> dict[str, tuple[str, str]]:
        return {i: (j.job_name, j.specifier) for i, j in self.snapshot().items() if (job_name or "") in j.job_name and (specifier or "") in j.specifier}

    def get_jobs_by_status(self, status: Status | str) -> list[str]:
        wanted = int(Status[status] if isinstance(status, str) else status)
        return [i for i, j in self.snapshot().items() if j.status == wanted]

    def get_job_info(self, id_: str) -> JobState:
        return self._one(self.snapshot(), id_)

    def get_job_status(self, id_: str) -> Status:
        return Status(self.get_job_info(id_).status)

    def get_summary(self) -> dict[Status, int]:
        states = [j.status for j in self.snapshot().values()]
        return {s: states.count(int(s)) for s in Status}

    @property
    def complete(self) -> bool:
        states = [j.status for j in self.snapshot().values()]
        return bool(states) and set(states) == {int(Status.SUCCEEDED)}

    @property
    def encountered_error(self) -> bool:
        return any(j.status == Status.FAILED for j in self.snapshot().values())

    def summarize(self) -> dict:
        """Counts, label and details; an error message is left out where there is none."""
        jobs, by = self.snapshot(), self.get_summary()
        numbers = {"total": len(jobs), "succeeded": by[Status.SUCCEEDED], "failed": by[Status.FAILED], "running": by[Status.RUNNING], "scheduled": by[Status.SCHEDULED]}
        details = [{"job_id": i, "job_name": j.job_name, "specifier": j.specifier, "status": Status(j.status).name} | ({"error_message": j.error_message} if j.error_message is not None else {}) for i, j in jobs.items()]
        return numbers | {"status": resolve_status(numbers).value, "jobs": details}


def scan(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All registries with this file name below a directory: (registry, and the columns of JOB), one row for each job.

    The tree is listed and the files are parsed in tasks; a file that is no registry is an error. Registries without jobs
    give no rows.
    """

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path in part["path"]:
                jobs = Registry.from_yaml(path).jobs
                rows = [(path, k, i, *(asdict(j)[c] for c in JOB.names[2:])) for k, (i, j) in enumerate(jobs.items())]
                yield pd.DataFrame(rows, columns=["registry", *JOB.names]).astype({"started_at": "Int64", "completed_at": "Int64"})

    ship(spark)
    files = discovery.walk_files(spark, root).filter(F.col("name") == name).select("path")
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInPandas(parse, StructType([StructField("registry", StringType()), *JOB.fields]))


def resolve_status(summary: dict[str, int]) -> Label:
    """label() for counts in a dictionary."""
    n = {k: summary.get(k, 0) for k in ("total", "succeeded", "failed", "running", "scheduled")}
    rules = (
        (n["failed"] > 0, Label.FAILED),
        (0 < n["total"] == n["succeeded"], Label.COMPLETED),
        (n["running"] > 0, Label.PROCESSING),
        (0 < n["total"] == n["scheduled"], Label.NOT_STARTED),
    )
    return next((name for holds, name in rules if holds), Label.IN_PROGRESS)
