"""Session helpers of the operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch between the JVM and Python, where the session has Spark's default of 64 MB: both hold a few of them for each task.
ARROW_BYTES = 8 << 20
_ARROW_LIMIT, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Ready a session: small Arrow batches, and Python workers that can import this package.

    The package is added to the application, once, where its folder is not on the workers' path.
    """
    if spark.conf.get(_ARROW_LIMIT) == _ARROW_DEFAULT:
        spark.conf.set(_ARROW_LIMIT, f"{ARROW_BYTES}b")
    context = spark.sparkContext
    on_path = str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if on_path or (context.master.startswith("local[") and os.getcwd() == str(_ROOT)) or context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="chronolith-")  # the driver's copy, which it serves as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/chronolith-{context.applicationId}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((_ROOT / "chronolith").rglob("*.py")):
            out.write(path, path.relative_to(_ROOT))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


#: What this Python worker keeps from one task to the next, by name.
_kept: dict[str, Any] = {}
_LIBC = ctypes.CDLL(None)


def kept(name: str, make: Callable[[], Any]) -> Any:
    """An object that outlives its task in a Python worker, until a task runs there that does not ask to keep it."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def _begin(keep: str | None) -> None:
    others = [name for name in _kept if name != keep]
    for name in others:
        del _kept[name]
    if others:
        gc.collect()


def hand_back() -> None:
    """Give freed memory back to the system; Arrow's pool and malloc (glibc's) otherwise stay as large as they ever were."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim is not None:
        trim(0)


def streamed(run: Callable, keep: str | None = None) -> Callable:
    """A function for ``mapInArrow`` that leaves its Python worker small."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(keep)
        try:
            yield from run(batches)
        finally:
            hand_back()

    return task


def grouped(run: Callable) -> Callable:
    """A function for ``applyInArrow`` of one group that leaves its Python worker small."""

    def group(table: pa.Table) -> pa.Table:
        _begin(None)
        try:
            return run(table)
        finally:
            hand_back()

    return group


def cogrouped(run: Callable) -> Callable:
    """As ``grouped``, for two groups."""

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        _begin(None)
        try:
            return run(left, right)
        finally:
            hand_back()

    return group


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and all run on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if found:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(found)
        return found.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="chronolith-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder; lost executors don't lose them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of ids or hashes, at most, that are broadcast: some ten megabytes.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A checkpoint of a narrow side of a join, marked for broadcast only if its counted rows are few; else it is shuffled."""
    found = checkpointed(df)
    return F.broadcast(found) if found.count() <= BROADCAST_ROWS else found.hint("merge")


#: Keys with more rows are joined by broadcast, the largest first, and at most ``BROADCAST_ROWS`` of them.
HOT_ROWS = 1000


def hand_out(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``values``, where a key has one row with ``n``, the rows it goes to, and what to give them.

    The hottest keys are broadcast, so that their rows stay where they are; all others are joined by a shuffle,
    where no task gets more than a key's share of them.  Both sides should be checkpoints: they are read more than once.
    """
    hot = checkpointed(values.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), key).limit(BROADCAST_ROWS).drop("n"))
    given = values.drop("n")
    if hot.isEmpty():
        return rows.join(given, key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(others.join(given, key))


def make_dir(spark: SparkSession, directory: str) -> None:
    """Create a folder in whatever store it names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared folder, which goes when the driver ends: results are read from it until then."""
    directory = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    make_dir(spark, directory)
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return directory
