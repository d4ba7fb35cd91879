"""Writing an intermediate result once, where every executor can read it again.

Loops (clustering) and documents with many reports read the same input many times.
``stage`` writes that input as Parquet below ``spark.checkpoint.dir``, so a lost
executor costs a re-read and never a recomputation, and later passes prune columns.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Rows of a file that many passes read.
FILE_ROWS = 2_000_000
_STAGED: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="parapet-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local temporary one only for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    # local and local[...] run in this process; local-cluster[...] has executors of its own.
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return _local_folder()
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, every table that was staged inside it.

    For work that ends with its results written, not for frames that are still to be read.
    """
    token = _STAGED.set([])
    try:
        yield
    finally:
        paths = _STAGED.get()
        _STAGED.reset(token)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame, name: str, spread_by: str | None = None, rows: int = 0, sort_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the frame that reads it.

    ``spread_by`` names a unique column to spread the rows evenly by before writing: one
    shuffle that pays when dozens of passes read the result. ``rows``, if known, makes the
    number of files grow with the table. ``sort_by`` orders the rows of each file.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _STAGED.get() is not None:
        _STAGED.get().append(path)
    if spread_by is not None:
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, rows // FILE_ROWS)
        df = df.repartition(files, spread_by)
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
