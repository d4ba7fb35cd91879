"""The carbon benchmark document: scatter columns and four heatmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession

from parapet.operators import crosstab
from parapet.sources import readers, writers

# More rows than these are not collected; the scatter is then the data set that ``run`` writes.
SCATTER_ROWS = 100_000


def heatmap(cells: list[Row], table: str, measure: str) -> dict:
    """One matrix as ``z`` (rows of values), ``x`` (column labels) and ``y`` (row labels), axes sorted."""
    rows = [r for r in cells if r["heatmap"] == table]
    y = sorted({r["row"] for r in rows})
    x = sorted({r["foundation"] for r in rows})
    values = {(r["row"], r["foundation"]): r[measure] for r in rows}
    return {"z": [[values[a, b] for b in x] for a in y], "x": x, "y": y}


def document(clf: DataFrame, folder: str | None = None) -> dict:
    """The whole document; the matrices have one value per pair of labels.

    A scatter too large for it is written below ``folder``, where the document then says it lies; without a folder
    it is the one that :func:`run` writes.
    """
    scatter = crosstab.clf_scatter(clf).select(*crosstab.SCATTER_COLUMNS).limit(SCATTER_ROWS + 1).collect()
    cells = crosstab.clf_heatmaps(clf).collect()
    small = len(scatter) <= SCATTER_ROWS
    place = "scatter" if folder is None else f"{folder}/scatter"
    if not small and folder is not None:
        writers.write_records(crosstab.clf_scatter(clf), place)
    out = {"scatter_data": {c: [r[c] for r in scatter] for c in crosstab.SCATTER_COLUMNS} if small else {"path": place}}
    for table in ("material", "struct"):
        out[f"heatmap_{table}_count"] = heatmap(cells, table, "n")
        out[f"heatmap_{table}_gfa"] = heatmap(cells, table, "area")
    return out


def run(spark: SparkSession, csv_path: str, folder: str) -> DataFrame | None:
    """Read the table and write scatter rows and heatmap cells; None when there is no file."""
    clf = readers.read_clf(spark, csv_path)
    if clf is None:
        return None
    writers.write_records(crosstab.clf_scatter(clf), f"{folder}/scatter")
    writers.write_records(crosstab.clf_heatmaps(clf), f"{folder}/heatmaps")
    return clf
