"""Shoreline buildings: CSV to JSON records with the guaranteed columns and explicit nulls."""

from __future__ import annotations

from pyspark.sql import SparkSession

from parapet.sources import readers, writers


def run(spark: SparkSession, csv_path: str, folder: str) -> None:
    """Only NaN becomes null here; an infinite value is written as it is."""
    writers.write_records(readers.read_shoreline(spark, csv_path), folder, inf=False)
