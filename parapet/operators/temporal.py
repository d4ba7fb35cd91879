"""Reports over the year of construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parapet.functions.bands import ERA_SPLIT, decade_label, display_year
from parapet.functions.numbers import counted, mean_area, mean_year, percent, truncate

LAST_DECADE_END = 2030


def annual_series(cluster_rows: DataFrame) -> DataFrame:
    """Count, mean and total area per year and class, over the complete-case table."""
    series = cluster_rows.groupBy(truncate(F.col("year_built")).alias("year"), "occ_cls", "year_built").agg(
        counted(cluster_rows).alias("n"), mean_area(cluster_rows).alias("avg_area"), F.sum("gfa").alias("total_area")
    )
    return series.select("year", display_year(F.col("year")).alias("display_year"), "occ_cls", "n", "avg_area", "total_area")


def yearly_counts(df: DataFrame) -> DataFrame:
    """Buildings per year and class."""
    counts = df.where("year_built IS NOT NULL").groupBy(truncate(F.col("year_built")).alias("year"), "occ_cls").agg(
        F.count("occ_cls").alias("n")
    )
    return counts.where("n > 0")


def normalised_series(df: DataFrame) -> DataFrame:
    """Share of each class in its year. The window runs over the yearly counts."""
    total = F.sum("n").over(Window.partitionBy("year"))
    return yearly_counts(df).withColumn("share", F.col("n") / total)


def cumulative_series(df: DataFrame) -> DataFrame:
    """Running total of each class over the years."""
    running = Window.partitionBy("occ_cls").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return yearly_counts(df).withColumn("running", F.sum("n").over(running))


def floor_area_trend(df: DataFrame) -> DataFrame:
    """Total floor area built per year."""
    return df.groupBy(truncate(F.col("year_built")).alias("year")).agg(F.sum("gfa").alias("total_area"))


def historic_summary(df: DataFrame) -> DataFrame:
    """One row about buildings before 1940: totals, residential or not, share of all."""
    old = F.col("year_built") < ERA_SPLIT
    home = F.col("occ_cls") == "Residential"
    return df.agg(
        counted(df, old).alias("total_count"),
        counted(df, old & home).alias("residential_count"),
        counted(df, old & ~home).alias("non_residential_count"),
        percent(counted(df, old), counted(df)).alias("percentage_of_total"),
    )


def historic_classes(df: DataFrame) -> DataFrame:
    """Buildings before 1940 per class."""
    old = df.where(F.col("year_built") < ERA_SPLIT)
    return old.groupBy("occ_cls").agg(counted(df, F.col("occ_cls").isNotNull()).alias("n")).where("n > 0")


def decade_classes(df: DataFrame) -> DataFrame:
    """Buildings per decade and class from 1940 to 2029, with the decade's total.

    The total includes rows without a class, which have no row of their own.
    """
    recent = df.where((F.col("year_built") >= ERA_SPLIT) & (F.col("year_built") < LAST_DECADE_END))
    counts = recent.groupBy(decade_label(F.col("year_built")).alias("decade"), "occ_cls").agg(counted(df).alias("n"))
    with_total = counts.withColumn("total", F.sum("n").over(Window.partitionBy("decade")))
    return with_total.where("occ_cls IS NOT NULL")


def summary(df: DataFrame) -> DataFrame:
    """One row: size, mean year and area, year range and the classes."""
    return df.agg(
        counted(df).alias("total_buildings"),
        truncate(mean_year(df)).alias("avg_year_built"),
        mean_area(df).alias("avg_area_sqm"),
        truncate(F.min("year_built")).alias("min_year"),
        truncate(F.max("year_built")).alias("max_year"),
        F.array_join(F.sort_array(F.collect_set("occ_cls")), "|").alias("occupancy_classes"),
    )


def area_weighted(df: DataFrame, by: str, columns: tuple[str, ...]) -> DataFrame:
    """Area-weighted means per group; a null value takes its area out of the weight too."""
    known = df.where(F.col(by).isNotNull())
    return known.groupBy(by).agg(*[
        F.try_divide(
            F.sum(F.col(c) * F.col("gfa")), F.sum(F.when(F.col(c).isNotNull(), F.col("gfa")))
        ).alias(f"{c}_weighted")
        for c in columns
    ])


def material_evolution(df: DataFrame, first: int = 1940, last: int = 2024) -> DataFrame:
    """Buildings and area per year and material."""
    span = df.where(F.col("year_built").between(first, last + 0.999999) & F.col("material_type").isNotNull())
    return span.groupBy(truncate(F.col("year_built")).alias("year"), "material_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("gfa").alias("total_area")
    )
