"""Binning: year bands, quantile bands, soil property bands and their texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band edges and labels of the reports.
YEAR_EDGES = (0.0, 1940.0, 1980.0)
YEAR_LABELS_HIERARCHY = ("Historic (<1940)", "Mid-Century (40-80)", "Modern (>1980)")
YEAR_LABELS_FLOW = ("Historic (<1940)", "Mid-Century (1940–1980)", "Modern (>1980)")
AREA_LABELS = ("Small", "Medium", "Large")
HEIGHT_LABELS = ("Short", "Mid", "High")
ENG_EDGES = (0.17, 0.24, 0.32)
ENG_LABELS = ("Favorable", "Fair", "Poor", "Very poor")
ERA_SPLIT = 1940


def left_closed(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Bands ``[e0,e1) [e1,e2) … [en,∞)``; below ``e0`` or at infinity there is no band."""
    out = F.when(c.isNull() | (c < edges[0]) | (c >= float("inf")), F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        out = out.when(c < upper, label)
    return out.otherwise(labels[len(edges) - 1])


def right_closed(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Bands ``(-∞,e0] (e0,e1] … (en,∞]``; negative infinity has no band."""
    out = F.when(c.isNull() | (c <= float("-inf")), F.lit(None).cast("string"))
    for upper, label in zip(edges, labels):
        out = out.when(c <= upper, label)
    return out.otherwise(labels[len(edges)])


def year_band(c: Column, labels: Sequence[str]) -> Column:
    return left_closed(c, YEAR_EDGES, labels)


def tercile_band(c: Column, p33: float, p67: float, labels: Sequence[str]) -> Column:
    """Three bands from zero at two quantiles; equal quantiles leave the middle empty."""
    return left_closed(c, (0.0, p33, p67), labels)


def engineering_class(c: Column) -> Column:
    return right_closed(c, ENG_EDGES, ENG_LABELS)


def era(c: Column) -> Column:
    return F.when(c < ERA_SPLIT, "pre1940").when(c >= ERA_SPLIT, "post1940")


def display_year(c: Column) -> Column:
    return F.when(c < ERA_SPLIT, f"pre-{ERA_SPLIT}").otherwise(c.cast("bigint").cast("string"))


def decade_label(c: Column) -> Column:
    return F.concat((F.floor(c / 10) * 10).cast("bigint").cast("string"), F.lit("s"))


def band_texts(area: Sequence[float], height: Sequence[float]) -> dict[str, Column]:
    """What the bands mean, as the texts shown beside the hierarchy."""
    a, h = [F.lit(float(x)) for x in area], [F.lit(float(x)) for x in height]
    return {
        "Area": F.format_string("Small (<%.0f sqm), Medium (%.0f-%.0f sqm), Large (>%.0f sqm)", a[0], a[0], a[1], a[1]),
        "Height": F.format_string("Short (<%.1fm), Mid (%.1f-%.1fm), High (>%.1fm)", h[0], h[0], h[1], h[1]),
        "Year": F.lit("Historic (<1940), Mid-Century (1940-1980), Modern (>1980)"),
        "Drainage": F.lit("Multiple classes including Well, Moderately, Poorly drained, etc."),
    }
