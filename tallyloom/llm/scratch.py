"""Shared scratch space: cutting lineage without losing rows when an executor goes."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where none is set and all runs in one process, as in tests."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tallyloom-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once as Parquet in the shared folder and read them from there.

    Used where several later jobs need the same rows, so that they are neither computed again
    nor lost with an executor.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Whole texts go to Python in Arrow batches of ``rows`` at most while jobs run inside; the session's own number holds again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Memory that a Python worker has freed goes back to the system: workers live on, and the next stage needs it elsewhere."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def giving_back(f):
    """A function of one group, or of two, that gives back what it has freed."""
    if len(inspect.signature(f).parameters) == 1:

        def of_one(a):
            try:
                return f(a)
            finally:
                give_back()

        return of_one

    def of_two(a, b):
        try:
            return f(a, b)
        finally:
            give_back()

    return of_two


#: Most bytes that a lookup may send to every executor.
MOST_SENT = 64 << 20
ROW_BYTES = 64


def lookup(df: DataFrame, name: str) -> DataFrame:
    """Narrow rows to join with: sent to all executors if they are few enough, else met by a shuffle."""
    rows = staged(df, name)
    return F.broadcast(rows) if rows.count() * ROW_BYTES <= MOST_SENT else rows


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint in the shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
