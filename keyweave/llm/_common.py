"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from keyweave.plans.frames import BROADCAST_BYTES, broadcast_if_small, checkpointed, in_few_parts, shared_dir

__all__ = ["BROADCAST_BYTES", "WORD", "ascii_lower", "broadcast_if_small", "checkpointed", "in_few_parts", "release_memory", "remove_shared", "scratch", "shared_path", "small_batches"]

#: Word characters are all but the six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"

#: What a Python worker gets at once: so many rows, and no more than so many bytes unless one row has more.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

#: Folders made since each open scratch began, innermost last.
_made: list[list[str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; removed at the end of the scratch it is made in, if in one."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def remove_shared(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the shared paths made inside at its end, by when results that read them must have been written or checkpointed."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            remove_shared(spark, path)


def release_memory() -> None:
    """Gives freed buffers back to the system. For workers that have just let go of a block of texts: they live on after a task, and would keep it beside the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def ascii_lower(column):
    """A-Z lower-cased, all else as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands texts to Python in batches of BATCH_ROWS and BATCH_BYTES at most; whole texts are much for a worker and for the buffers that feed it."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
