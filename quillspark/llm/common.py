"""Shared plumbing: the cluster's shared folder, written intermediate tables, Arrow batch slicing."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows handled at a time inside a Python worker; bounds the Python copies of a batch's texts.
SLICE_ROWS = 256
#: Rows that Spark puts into one Arrow batch, instead of its default of 10,000: texts are long, and each batch is held by the JVM and the worker.
ARROW_ROWS, _ROWS_KEY = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Text bytes handled at a time inside a Python worker.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset, a temporary folder takes its place in local mode; a cluster must name one, as its machines don't share their own folders.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="quillspark-")
        shared_dir.own = path
    return path.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder. What is left in it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}"
    if path not in (held := own_dir.__dict__.setdefault("held", set())):
        held.add(path)
        atexit.register(_leave, spark, path)
    return path


def _leave(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application, and keep Arrow batches small.

    A session that has its own batch size keeps it.
    """
    if spark.conf.get(_ROWS_KEY, "10000") == "10000":
        spark.conf.set(_ROWS_KEY, ARROW_ROWS)
    app = spark.sparkContext.applicationId
    if getattr(ship, "done", None) == app:
        return
    top = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="quillspark-ship-"), f"{top.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(target)
    ship.done = app


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.written_at)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Give back to the system what a task's Arrow pool and allocator still hold when it ends: workers live on and wait beside the JVM."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return tidied


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into small ones, so that Python objects exist for a few texts at a time."""
    for batch in batches:
        sizes = batch.column(text).nbytes // max(1, batch.num_rows)
        step = max(1, min(rows, SLICE_BYTES // max(1, sizes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
