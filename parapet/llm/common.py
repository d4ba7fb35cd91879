"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the word contracts: space and the five controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row, however often ``body`` names it."""
    return F.transform(F.array(value), body).getItem(0)


def boxed(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as one struct ``row`` beside working columns, so that no name can clash."""
    return df.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in columns.items()])


def unboxed(df: DataFrame, fields: list[str], **columns: Column) -> DataFrame:
    """The columns of ``row`` again; ``columns`` replace those of their name or follow them."""
    fresh = {name.lower(): c.alias(name) for name, c in columns.items()}
    kept = [fresh.pop(f.lower(), F.col("row").getField(f).alias(f)) for f in fields]
    return df.select(*kept, *fresh.values())


def words_of(text: Column) -> Column:
    """Words of a text as an array; no text or no word gives an empty array."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_RUN)).otherwise(F.array().cast("array<string>"))
