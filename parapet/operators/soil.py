"""Soil statistics and the high-risk flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parapet.functions.bands import ENG_LABELS
from parapet.functions.numbers import counted, mean_year, percent, truncate
from parapet.functions.text import MISSING
from parapet.operators.distribution import by_frequency, many_group_counts, value_counts
from parapet.operators.quantiles import exact_quantiles
from parapet.staging import stage

# What counts as high risk, and the length of the component list.
RISK_DRAINAGE = ("Poorly drained", "Very poorly drained")
RISK_FLOODING = ("High",)
TOP_COMPONENTS = 20
TOP_COMPONENTS_PER_CLASS = 10
SOIL_COLUMNS = {"drainage": "drainagecl", "flooding": "flodfreqcl", "engineering": "eng_class", "components": "compname"}


def is_high_risk() -> Column:
    """Never null: a missing value is not a risk."""
    risky = F.col("drainagecl").isin(*RISK_DRAINAGE)
    flooded = F.col("flodfreqcl").isin(*RISK_FLOODING)
    return F.coalesce(risky, F.lit(False)) | F.coalesce(flooded, F.lit(False))


def water_table_stats(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Mean, spread, range and quartiles of the water table depth, one row; ``accuracy`` asks for sketched quartiles."""
    found = exact_quantiles(df, "wtdepannmin", (0.25, 0.5, 0.75), accuracy=accuracy)
    m = found.moments.get(None)
    moments = (m.mean, m.deviation, m.low, m.high) if m else (None,) * 4
    names = ("mean", "std", "min", "max", "median", "q25", "q75")
    return df.sparkSession.createDataFrame([(*moments, *[found.value(p) for p in (0.5, 0.25, 0.75)])], ", ".join(f"{n} double" for n in names))


def water_table_by_class(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Mean, median and spread of the water table depth per class that has any, from the passes of the median."""
    found = exact_quantiles(df, "wtdepannmin", (0.5,), by="occ_cls", accuracy=accuracy)
    rows = [(cls, m.mean, found.value(0.5, cls), m.deviation) for cls, m in found.moments.items()]
    return df.sparkSession.createDataFrame(rows, "occ_cls string, mean double, median double, std double")


def component_ranking(df: DataFrame, k: int = TOP_COMPONENTS) -> DataFrame:
    """The ``k`` most frequent soil components and the missing entry, with unrounded shares.

    Every row also carries the number of distinct values (null is one) and the share of all
    rows that the ``k`` components cover. The counts, a row per component, are named five times and so staged.
    """
    counts = stage(value_counts(df, "compname", keep_missing=True), "components")
    known = F.col("value") != MISSING
    top = by_frequency(counts.where(known), "value", k)
    whole = counts.agg(F.sum("n")).scalar()
    return top.unionByName(counts.where(~known)).select(
        "value", "n", percent(F.col("n"), whole, None).alias("pct"),
        counts.agg(F.count(F.lit(1))).scalar().alias("total_unique"),
        percent(top.agg(F.sum("n")).scalar(), whole, None).alias("top_coverage"),
    )


def risk_summary(df: DataFrame) -> DataFrame:
    """One row about high-risk buildings: count, share, mean year and area."""
    risk = is_high_risk()
    return df.agg(
        counted(df, risk).alias("high_risk_count"),
        percent(counted(df, risk), counted(df)).alias("high_risk_percentage"),
        F.coalesce(truncate(mean_year(df, risk)), F.lit(0)).alias("high_risk_avg_year"),
        F.coalesce(F.sum(F.when(risk, F.col("gfa"))), F.lit(0.0)).alias("high_risk_total_area"),
    )


def risk_by_class(df: DataFrame) -> DataFrame:
    """High-risk buildings per class."""
    return value_counts(df.where(is_high_risk()), "occ_cls", "occ_cls")


def soil_by_class(df: DataFrame) -> DataFrame:
    """(what, occ_cls, value, n): drainage, flooding, engineering class and the top components per class.

    All four come from one pass; the counts, a row per label, are staged because zero rows
    of the engineering labels are added to them.
    """
    return ranked_counts(stage(many_group_counts(df, "occ_cls", SOIL_COLUMNS), "soil-counts"))


def ranked_counts(counts: DataFrame) -> DataFrame:
    """:func:`soil_by_class` from its counts."""
    labels = F.explode(F.array(*[F.lit(x) for x in ENG_LABELS]))
    zeros = counts.select("occ_cls").distinct().select(F.lit("engineering").alias("what"), "occ_cls", labels.alias("value"), F.lit(0).cast("bigint").alias("n"))
    full = counts.unionByName(zeros).groupBy("what", "occ_cls", "value").agg(F.sum("n").alias("n"))
    missing = F.col("value") == MISSING
    order = Window.partitionBy("what", "occ_cls", missing).orderBy(F.desc("n"), "value")
    ranked = full.withColumn("_rank", F.row_number().over(order))
    return ranked.where((F.col("what") != "components") | missing | (F.col("_rank") <= TOP_COMPONENTS_PER_CLASS)).drop("_rank")
