"""The chain every report starts from: clean, repair classes, renew mix labels, name soil bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.functions.bands import engineering_class
from parapet.operators import classes, cleaning


def resolved(raw: DataFrame) -> DataFrame:
    """Cleaned rows with repaired classes and the audit columns of the repair."""
    return classes.resolve_classes(cleaning.clean(raw))


def prepared(raw: DataFrame) -> DataFrame:
    """The reporting table. A lazy chain of row-wise steps: no shuffle of its own."""
    mixed = classes.recalculate_mix(resolved(raw))
    return mixed.withColumn("eng_class", engineering_class(F.col("eng_property")))
