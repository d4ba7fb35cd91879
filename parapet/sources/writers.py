"""JSON sinks. Spark writes partitioned JSON Lines; nothing is gathered to be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.functions.numbers import null_non_finite

KEEP_NULLS = {"ignoreNullFields": "false"}


def as_records(df: DataFrame, columns: list[str] | None = None) -> Column:
    """One JSON object per row with explicit nulls."""
    return F.to_json(F.struct(*(columns or df.columns)), KEEP_NULLS)


def write_records(df: DataFrame, path: str, inf: bool = True) -> None:
    """JSON Lines with explicit nulls; NaN (and the infinities unless ``inf`` is false) become null."""
    null_non_finite(df, inf).write.option("ignoreNullFields", "false").json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One folder per sample type and chunk, rows inside in sample order.

    Rows of a chunk are brought together by hash partitioning on type and chunk, so a
    chunk of at most a few thousand rows is written by one task as one file.
    """
    ordered = null_non_finite(chunks).repartition("type", "chunk_index").sortWithinPartitions("type", "chunk_index", "sample_index")
    ordered.write.option("ignoreNullFields", "false").partitionBy("type", "chunk_index").json(path)
