"""Counting values: frequency tables, top-k, shares and small lookups on top of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parapet.functions.numbers import WEIGHT, counted, percent
from parapet.functions.text import MISSING

# The mix labels of the overview.
MIX_LABELS = {
    "MIX_SC1": "1 Conflict Type (MIX_SC1)",
    "MIX_SC2": "Same & Different Types (MIX_SC2)",
    "MIX_SC3": ">1 Conflict Types (MIX_SC3)",
}
MIX_NONE = "Same Type Only"


def value_counts(df: DataFrame, column: str | Column, name: str = "value", keep_missing: bool = False) -> DataFrame:
    """Rows per value; nulls are left out, or counted under a label of their own.

    The null group is dropped by its count of non-null values after the aggregate: a filter
    on the value itself would be pushed below and compute an expensive label twice.
    """
    c = F.col(column) if isinstance(column, str) else column
    label = F.coalesce(c, F.lit(MISSING)) if keep_missing else c
    weight = [WEIGHT] if WEIGHT in df.columns else []
    return df.select(label.alias(name), *weight).groupBy(name).agg(counted(df, F.col(name).isNotNull()).alias("n")).where(F.col("n") > 0)


def by_frequency(counts: DataFrame, name: str, k: int | None = None) -> DataFrame:
    """Most frequent first, ties by label; the first ``k`` only when given."""
    ordered = counts.orderBy(F.desc("n"), F.asc_nulls_last(name))
    return ordered if k is None else ordered.limit(k)


def top_values(df: DataFrame, column: str, k: int, keep_null: bool = False) -> DataFrame:
    """The ``k`` most frequent values of a column: at most ``k`` rows, safe to broadcast."""
    size = F.count(F.lit(1)) if keep_null else F.count(column)
    counts = df.groupBy(F.col(column).alias("value")).agg(size.alias("n")).where(F.col("n") > 0)
    return by_frequency(counts, "value", k)


def recode_rare(df: DataFrame, column: str, k: int, other: str, into: str, keep_null: bool = False) -> DataFrame:
    """Keep the ``k`` most frequent values of ``column``, everything else becomes ``other``.

    With ``keep_null`` a null may itself be one of the frequent values and then stays null.
    """
    top = top_values(df, column, k, keep_null).select(F.col("value").alias("_top"), F.lit(True).alias("_hit"))
    joined = df.join(F.broadcast(top), F.col(column).eqNullSafe(F.col("_top")), "left")
    return joined.withColumn(into, F.when(F.col("_hit"), F.col(column)).otherwise(other)).drop("_top", "_hit")


def value_shares(df: DataFrame, column: str, labels: Sequence[str] = ()) -> DataFrame:
    """Counts with the missing label, and unrounded percentages of all rows.

    ``labels`` are listed even when no row has them.
    """
    counts = value_counts(df, column, keep_missing=True)
    if labels:
        empty = df.sparkSession.createDataFrame([(x, 0) for x in labels], "value string, n bigint")
        counts = counts.unionByName(empty).groupBy("value").agg(F.sum("n").alias("n"))
    return counts.withColumn("pct", percent(F.col("n"), counts.agg(F.sum("n")).scalar(), None))


def mix_distribution(df: DataFrame) -> DataFrame:
    """Buildings per mix label; a null code means one type only, unknown codes are not reported."""
    label = F.when(F.col("mix_sc").isNull(), MIX_NONE)
    for code, text in MIX_LABELS.items():
        label = label.when(F.col("mix_sc") == code, text)
    return value_counts(df, label, "label")


def group_value_counts(
    df: DataFrame, by: str, column: str, top_k: int | None = None, labels: Sequence[str] = ()
) -> DataFrame:
    """Counts of ``column`` per group with the missing label, optionally the top ``k`` of each group.

    The missing label is kept besides the top ``k``. One aggregate serves all groups, so a
    dominant group is pre-aggregated on the map side like any other.
    """
    value = F.coalesce(F.col(column), F.lit(MISSING)).alias("value")
    counts = df.groupBy(by, value).agg(F.count(by).alias("n")).where(F.col("n") > 0)
    if labels:
        listed = counts.select(by).distinct().select(by, F.explode(F.array(*[F.lit(x) for x in labels])).alias("value"))
        zeros = listed.withColumn("n", F.lit(0).cast("bigint"))
        counts = counts.unionByName(zeros).groupBy(by, "value").agg(F.sum("n").alias("n"))
    if top_k is None:
        return counts
    missing = F.col("value") == MISSING
    order = Window.partitionBy(by).orderBy(F.desc("n"), "value")
    ranked = counts.where(~missing).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top_k)
    return ranked.drop("_rank").unionByName(counts.where(missing))


def many_group_counts(df: DataFrame, by: str, columns: Mapping[str, str]) -> DataFrame:
    """(what, by, value, n): counts of several columns per group, missing label included, in one pass.

    ``columns`` maps the name in ``what`` to the column; rows without a group are left out.
    """
    pairs = F.array(*[
        F.struct(F.lit(what).alias("what"), F.coalesce(F.col(c), F.lit(MISSING)).alias("value")) for what, c in columns.items()
    ])
    return df.select(by, F.inline(pairs)).groupBy("what", by, "value").agg(F.count(by).alias("n")).where(F.col("n") > 0)


def most_frequent(df: DataFrame, by: Sequence[str], column: str, into: str) -> DataFrame:
    """The most frequent non-null value of each group, ties to the smaller label.

    Counting first means a group's rows are never gathered; the choice runs over counts.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    first = F.min_by(F.col(column), F.struct((-F.col("_n")).alias("o"), F.col(column)))
    return counts.groupBy(*by).agg(first.alias(into))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Every distinct value, null included."""
    return df.select(column).distinct()
