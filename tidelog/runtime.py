"""What runs need: this package on workers, results that are kept, and bounds on the threads of numerical libraries."""

from __future__ import annotations

import atexit
import importlib.util
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What the libraries read at their start. Fixed values.
THREAD_VARIABLES = (
    "OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS", "NUMEXPR_NUM_THREADS", "VECLIB_MAXIMUM_THREADS",
    "POLARS_MAX_THREADS", "OPENCV_FFMPEG_THREADS", "TIFFFILE_NUM_THREADS",
)


def thread_settings(thread_count: int = 1) -> dict[str, str]:
    """Spark settings that bound the threads of each Python worker. ValueError below 1."""
    return {f"spark.executorEnv.{name}": value for name, value in _bound(thread_count).items()}


def _bound(thread_count: int) -> dict[str, str]:
    if thread_count < 1:
        raise ValueError("at least one thread is needed")
    return dict.fromkeys(THREAD_VARIABLES, str(thread_count))


def initialize_worker_threads(thread_count: int = 1) -> None:
    """Bound the threads of this process for good; for the start of a worker.

    numba reads its variable when it is imported, so where it is there it is told as well, up to what it then allowed.
    """
    os.environ |= _bound(thread_count)
    if importlib.util.find_spec("numba"):
        numba = importlib.import_module("numba")
        numba.set_num_threads(min(thread_count, numba.config.NUMBA_NUM_THREADS))


@contextmanager
def limit_worker_threads(thread_count: int = 1) -> Iterator[None]:
    """Local mode starts its Python workers from the driver: those that are started inside are bound."""
    with ExitStack() as undo:
        for name, value in _bound(thread_count).items():
            undo.callback(_put, name, os.environ.pop(name, None))
            _put(name, value)
        yield


def _put(name: str, value: str | None) -> None:
    if value is not None:
        os.environ[name] = value
    else:
        os.environ.pop(name, None)


def ship(spark: SparkSession) -> None:
    """Give the package to the workers of a session, once: they may run on other machines, or from another folder."""
    context = spark.sparkContext
    if getattr(context, "_tidelog_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="tidelog-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # Spark hands the file out until it ends
    path = os.path.join(folder, "tidelog.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for own, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    whole = os.path.join(own, name)
                    archive.write(whole, os.path.relpath(whole, os.path.dirname(top)))
    context.addPyFile(path)
    context._tidelog_shipped = True  # noqa: SLF001


def kept(df: DataFrame) -> DataFrame:
    """df, run once: its rows are in the checkpoint folder that executors share. For what comes out otherwise each time it runs."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():  # noqa: SLF001
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidelog-"))
    return df.checkpoint()
