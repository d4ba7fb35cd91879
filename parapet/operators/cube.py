"""One pass over the buildings for all reports on labels.

The reports need counts and sums over a few sets of label columns. All sets are grouped in the same
aggregate, so the table is read once and reduced in the tasks; a set has a row per label
combination that occurs, whatever the number of buildings. Operators take a view of the cube in
place of buildings: a row with the weight column stands for that many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.functions import bands as B
from parapet.functions.numbers import WEIGHT, YEARS
from parapet.functions.text import MISSING, has_text
from parapet.operators.classes import HAS_VOTES
from parapet.operators.cleaning import CLUSTER_COLUMNS
from parapet.operators.flows import YEAR_BAND
from parapet.operators.soil import SOIL_COLUMNS

#: Whether a building has all columns that clustering and the annual series need.
COMPLETE = "_complete"
SETS = {
    "years": ("occ_cls", "year_built", "material_type", "foundation_type", COMPLETE),
    "flow": (YEAR_BAND, "occ_cls", "material_type", "foundation_type", "compname"),
    "soil": ("occ_cls", "drainagecl", "flodfreqcl"),
    "engineering": ("occ_cls", "eng_class"),
    "mix": ("mix_sc",),
    "use": ("occ_cls", "prim_occ"),
    "repair": ("outcome", HAS_VOTES, "occ_cls_orig", "occ_cls", "vote_class", "tie"),
}
COLUMNS = tuple(dict.fromkeys(c for found in SETS.values() for c in found))


def label_cube(prepared: DataFrame) -> DataFrame:
    """Rows, area and sum of years per combination of every set; ``_set`` tells the sets apart."""
    complete: Column = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in CLUSTER_COLUMNS])
    labelled = prepared.withColumns({
        YEAR_BAND: B.year_band(F.col("year_built"), B.YEAR_LABELS_FLOW), COMPLETE: complete, HAS_VOTES: has_text(F.col("occ_dict")), "_year": F.col("year_built"),
    }).select(*COLUMNS, "gfa", "_year")
    grouped = labelled.groupingSets([[F.col(c) for c in found] for found in SETS.values()], *[F.col(c) for c in COLUMNS])
    return grouped.agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias(WEIGHT), F.sum("gfa").alias("gfa"), F.sum("_year").alias(YEARS))


def view(cube: DataFrame, name: str) -> DataFrame:
    """The rows of one set, with its columns and measures."""
    absent = sum(1 << i for i, c in enumerate(reversed(COLUMNS)) if c not in SETS[name])
    return cube.where(F.col("_set") == absent).select(*SETS[name], WEIGHT, "gfa", YEARS)


def soil_counts(cube: DataFrame) -> DataFrame:
    """(what, occ_cls, value, n): buildings per class and value of each soil column, a missing value under its label."""
    parts = []
    for what, column in SOIL_COLUMNS.items():
        found = view(cube, next(name for name, columns in SETS.items() if column in columns))
        label = F.coalesce(F.col(column), F.lit(MISSING)).alias("value")
        known = found.where("occ_cls IS NOT NULL").groupBy(F.lit(what).alias("what"), "occ_cls", label)
        parts.append(known.agg(F.sum(WEIGHT).alias("n")))
    return reduce(DataFrame.unionByName, parts)
