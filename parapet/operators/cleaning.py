"""The cleaning funnel: filters in a fixed order, and one pass that counts every step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.functions.numbers import as_number, null_non_finite, percent
from parapet.operators.quantiles import exact_quantiles
from parapet.sources.schema import BUILDING_TYPES, ensure_columns
from parapet.staging import stage

# The outlier quantile and the complete-case columns of the clustering table.
OUTLIER_QUANTILE = 0.99999
CLUSTER_COLUMNS = (
    "occ_cls", "gfa", "sqmeters", "height_used", "pred_height", "year_built", "material_type", "foundation_type",
)


def valid_year() -> Column:
    return F.col("year_built") > 0


def valid_area() -> Column:
    return F.col("gfa") > 0


def valid_raw_height() -> Column:
    """A missing or unreadable height passes, a height of zero or less does not."""
    return F.col("height_num").isNull() | (F.col("height_num") > 0)


def valid_height() -> Column:
    return F.col("height_used") > 0


def with_heights(df: DataFrame) -> DataFrame:
    """``height_num`` read from text, and ``height_used`` that falls back to the predicted height."""
    measured, predicted = as_number(df, "height"), as_number(df, "pred_height")
    return (
        df.withColumn("height_num", measured)
        .withColumn("height_used", F.when(F.col("height_num") > 0, F.col("height_num")).otherwise(predicted))
        .withColumn("assumed_height", F.col("height_used"))
    )


def clean(df: DataFrame) -> DataFrame:
    """All filters on one scan, no shuffle. Non-finite numbers count as missing.

    Both height filters together say that the first known height is positive; said that way
    the height text is read once per row.
    """
    full = null_non_finite(ensure_columns(df, BUILDING_TYPES))
    first_known = F.coalesce(as_number(full, "height"), as_number(full, "pred_height"))
    return with_heights(full.where(valid_year() & valid_area() & (first_known > 0)))


def outlier_threshold(df: DataFrame, column: str = "gfa", accuracy: int | None = None) -> float | None:
    """The 99.999th percentile, interpolated; None for an empty frame.

    ``accuracy`` asks for a sketch; to tell this percentile from the largest value it must be well above 100,000.
    """
    return exact_quantiles(df, column, [OUTLIER_QUANTILE], accuracy=accuracy).value(OUTLIER_QUANTILE)


def drop_outliers(df: DataFrame, column: str = "gfa", accuracy: int | None = None) -> DataFrame:
    """Keep rows strictly below the threshold of this very frame."""
    threshold = outlier_threshold(df, column, accuracy)
    return df.where(F.lit(False) if threshold is None else F.col(column) < threshold)


def cleaning_funnel(df: DataFrame) -> DataFrame:
    """One row with every counter of the funnel.

    The few columns it needs are written once, since the quantile passes read them again; the
    raw table is read and parsed a single time.
    """
    full = with_heights(null_non_finite(ensure_columns(df, BUILDING_TYPES)))
    prepared = stage(full.select("year_built", "gfa", "height_num", "height_used"), "funnel")
    year, area = F.coalesce(valid_year(), F.lit(False)), F.coalesce(valid_area(), F.lit(False))
    raw_height, height = valid_raw_height(), F.coalesce(valid_height(), F.lit(False))
    threshold = outlier_threshold(prepared.where(year & area))
    above = F.lit(False) if threshold is None else F.col("gfa") > threshold
    cleaned = year & area & raw_height & height
    counted = prepared.agg(
        F.count(F.lit(1)).alias("initial_count"),
        F.count_if(~year).alias("invalid_year_count"),
        F.count_if(F.col("year_built") <= 0).alias("year_negative_or_zero"),
        F.count_if(F.col("year_built").isNull()).alias("year_missing"),
        F.count_if(year).alias("after_year_filter"),
        F.count_if(year & ~area).alias("missing_area_count"),
        F.count_if(year & area).alias("after_missing_area"),
        F.count_if(year & area & above).alias("area_outliers_count"),
        F.count_if(year & area & ~raw_height).alias("invalid_raw_height_count"),
        F.count_if(year & area & raw_height & ~height).alias("invalid_assumed_height_count"),
        F.count_if(cleaned).alias("after_height_filter"),
        F.count_if(cleaned & F.col("height_num").isNotNull()).alias("used_height"),
        F.count_if(cleaned & F.col("height_num").isNull()).alias("used_pred_height"),
    )
    removed = F.col("initial_count") - F.col("after_height_filter")
    return counted.select(
        "*",
        F.lit(len(df.columns)).alias("initial_columns"),
        F.lit(threshold).cast("double").alias("area_outlier_threshold"),
        F.col("after_missing_area").alias("after_outlier_removal"),
        F.col("after_height_filter").alias("final_count"),
        removed.alias("total_removed"),
        F.coalesce(percent(removed, F.col("initial_count")), F.lit(0.0)).alias("removal_percentage"),
    )


def quality_checks(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Negative areas and heights before and after cleaning, one row per stage."""

    def counted(df: DataFrame, stage: str) -> DataFrame:
        return df.agg(
            F.count_if(F.col("gfa") < 0).alias("negative_gfa"),
            F.count_if(as_number(df, "height") < 0).alias("negative_height"),
        ).select(F.lit(stage).alias("stage"), "*")

    return counted(raw, "raw").unionByName(counted(cleaned, "cleaned"))


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null in ``columns`` (all columns when none are named)."""
    return df.dropna("any", subset=list(columns) if columns else None)


def cluster_table(cleaned: DataFrame, remove_outliers: bool = False) -> DataFrame:
    """The complete-case projection that clustering and the annual series share."""
    projected = complete_cases(cleaned.select("build_id", *CLUSTER_COLUMNS), CLUSTER_COLUMNS)
    return drop_outliers(projected) if remove_outliers else projected


def large_groups(df: DataFrame, by: str, more_than: int) -> DataFrame:
    """Rows whose group has more than ``more_than`` rows.

    The counts are partial aggregates; the surviving group labels are few, so the semi
    join is a broadcast one and the rows themselves never move.
    """
    keep = df.groupBy(by).agg(F.count(by).alias("n")).where(F.col("n") > more_than)
    return df.join(keep.select(by), by, "left_semi")


def _building_types() -> dict[str, Column]:
    is_home = F.col("occ_cls") == "Residential"
    return {"All": F.lit(True), "Residential": is_home, "Non-Residential": ~is_home}


def building_type(df: DataFrame, kind: str) -> DataFrame:
    """``All``, ``Residential`` or ``Non-Residential`` buildings."""
    if kind not in _building_types():
        raise ValueError(f"unknown building type {kind!r}")
    return df if kind == "All" else df.where(_building_types()[kind])


def building_type_totals(df: DataFrame) -> DataFrame:
    """Buildings and area of each type (kind, n, area), in one aggregate."""
    kinds = _building_types()
    sums = df.agg(*[m for i, c in enumerate(kinds.values()) for m in (F.count_if(c).alias(f"n{i}"), F.sum(F.when(c, F.col("gfa"))).alias(f"a{i}"))])
    rows = [F.struct(F.lit(kind).alias("kind"), F.col(f"n{i}").alias("n"), F.col(f"a{i}").alias("area")) for i, kind in enumerate(kinds)]
    return sums.select(F.inline(F.array(*rows)))
