"""Reproducible random order: a hash of id and seed, the same on every engine and layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the seed of all samples.
SAMPLE_SEED = 337


def sample_key(id_col: Column, seed: int = SAMPLE_SEED) -> Column:
    return F.md5(F.concat(id_col.cast("string"), F.lit(f"#{seed}")).cast("binary"))


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the first 13 hex digits of a key."""
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**13))
