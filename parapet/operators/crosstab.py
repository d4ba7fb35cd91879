"""Crosstabs in long form: one row per cell, dense where the report is a matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parapet.functions.bands import era
from parapet.functions.numbers import counted
from parapet.operators.cleaning import complete_cases

# The column sets of the carbon benchmark report.
SCATTER_COLUMNS = ("gfa", "mass_total", "gwp_a_to_c", "occ_cls", "material_type", "str_sys_summary")
HEATMAP_LABELS = ("material_type", "general_fnd_type", "str_sys_summary")


def cells(df: DataFrame, by: Sequence[str], value: str = "gfa") -> DataFrame:
    """Count and value sum per combination; a null in any key drops the row, an empty sum is 0."""
    known = df.dropna("any", subset=list(by))
    total = F.coalesce(F.sum(value), F.lit(0.0))
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), total.alias("area"))


def dense(sparse: DataFrame, table: str, row: str, col: str, measures: Sequence[str]) -> DataFrame:
    """All row × column pairs of each table, missing cells filled with 0.

    Each row carries its cells as a map and the column labels of its table, so the full grid
    is made per row, without a cross join and without a second look at the input. The window
    and the maps see cells only, one per pair of labels.
    """
    labels = F.array_sort(F.collect_set(col).over(Window.partitionBy(table)))
    cell = F.struct(F.col(col), F.struct(*measures))
    by_row = sparse.withColumn("_labels", labels).groupBy(table, row).agg(
        F.map_from_entries(F.collect_list(cell)).alias("_cells"), F.first("_labels").alias("_labels")
    )
    grid = by_row.select(table, row, F.explode("_labels").alias(col), "_cells")
    found = F.try_element_at(F.col("_cells"), F.col(col))
    return grid.select(table, row, col, *[F.coalesce(found[m], F.lit(0)).alias(m) for m in measures])


def matrix(df: DataFrame, row: str, col: str, value: str = "gfa") -> DataFrame:
    """Count ``n`` and value sum ``area`` of every row and column label, also of pairs that never occur."""
    sparse = cells(df, (row, col), value).withColumn("_table", F.lit(0))
    return dense(sparse, "_table", row, col, ("n", "area")).drop("_table")


def axes(sparse: DataFrame, table: str, row: str, col: str) -> DataFrame:
    """The sorted axis labels of each table: (table, axis, label, position)."""
    sides = F.array(
        F.struct(F.lit("row").alias("axis"), F.array_sort(F.collect_set(row)).alias("labels")),
        F.struct(F.lit("column").alias("axis"), F.array_sort(F.collect_set(col)).alias("labels")),
    )
    listed = sparse.groupBy(table).agg(sides.alias("_sides")).select(table, F.inline("_sides"))
    return listed.select(table, "axis", F.posexplode("labels").alias("position", "label"))


def pivoted(sparse: DataFrame, row: str, col: str, measure: str, labels: Sequence[str]) -> DataFrame:
    """The matrix itself, one column per given label, for a sink that wants it."""
    return sparse.groupBy(row).pivot(col, list(labels)).agg(F.sum(measure)).fillna(0).orderBy(row)


def era_base(df: DataFrame) -> DataFrame:
    """Count and area per era, material, foundation and class: the one pass all era tables share.

    Null classes stay as a group of their own, since totals include them.
    """
    located = df.dropna("any", subset=["material_type", "foundation_type"])
    return located.groupBy(era(F.col("year_built")).alias("era"), "material_type", "foundation_type", "occ_cls").agg(
        counted(df).alias("n"), F.coalesce(F.sum("gfa"), F.lit(0.0)).alias("area")
    )


def _with_all(base: DataFrame) -> DataFrame:
    """Each aggregate row once for its era and once for ``all``."""
    return base.withColumn("era", F.explode(F.array(F.lit("all"), F.col("era")))).where("era IS NOT NULL")


def era_matrix(df: DataFrame) -> DataFrame:
    """Material × foundation counts and areas for all buildings and both eras, dense per era."""
    summed = _with_all(era_base(df)).groupBy("era", "material_type", "foundation_type").agg(
        F.sum("n").alias("n"), F.sum("area").alias("area")
    )
    return dense(summed, "era", "material_type", "foundation_type", ("n", "area"))


def cell_breakdown(df: DataFrame) -> DataFrame:
    """Per era and non-empty cell: the total over all rows, and count and area of each class.

    The total row has ``level`` total and no class.
    """
    base = _with_all(era_base(df))
    levels = F.array(
        F.struct(F.lit("total").alias("level"), F.lit(None).cast("string").alias("cls")),
        F.struct(F.lit("class").alias("level"), F.col("occ_cls").alias("cls")),
    )
    rows = base.select("*", F.inline(levels)).where((F.col("level") == "total") | F.col("cls").isNotNull())
    summed = rows.groupBy("era", "material_type", "foundation_type", "level", F.col("cls").alias("occ_cls")).agg(
        F.sum("n").alias("n"), F.sum("area").alias("area")
    )
    return summed.withColumn("cell", cell_key(F.col("material_type"), F.col("foundation_type")))


def cell_key(row: Column, col: Column) -> Column:
    """``row_col``; both labels stay beside it, since keys can collide."""
    return F.concat_ws("_", row, col)


def clf_scatter(clf: DataFrame) -> DataFrame:
    """Complete cases over the six scatter columns."""
    return complete_cases(clf.select("build_id", *SCATTER_COLUMNS) if "build_id" in clf.columns else clf.select(*SCATTER_COLUMNS), SCATTER_COLUMNS)


def clf_cells(clf: DataFrame) -> DataFrame:
    """Material × foundation and system × foundation cells, both from one pass.

    ``heatmap`` is material or struct. Rows need all three labels; a null area counts as 0.
    """
    labelled = complete_cases(clf, HEATMAP_LABELS)
    combos = labelled.groupBy(*HEATMAP_LABELS).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("gfa"), F.lit(0.0)).alias("area")
    )
    sides = F.array(
        F.struct(F.lit("material").alias("heatmap"), F.col("material_type").alias("row")),
        F.struct(F.lit("struct").alias("heatmap"), F.col("str_sys_summary").alias("row")),
    )
    spread = combos.select(F.inline(sides), F.col("general_fnd_type").alias("foundation"), "n", "area")
    return spread.groupBy("heatmap", "row", "foundation").agg(F.sum("n").alias("n"), F.sum("area").alias("area"))


def clf_heatmaps(clf: DataFrame) -> DataFrame:
    """Both heatmaps, dense."""
    return dense(clf_cells(clf), "heatmap", "row", "foundation", ("n", "area"))
