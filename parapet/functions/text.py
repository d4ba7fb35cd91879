"""Small text helpers shared by the label and vote expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that appear in the results.
UNCLASSIFIED = "Unclassified"
MISSING = "NaN (Missing)"
UNKNOWN = "Unknown"
WHITE_SPACE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` removes blanks only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def has_text(c: Column) -> Column:
    """True for text that is neither null, blank nor the word nan."""
    s = strip(c)
    return F.coalesce((s != "") & (F.lower(s) != "nan"), F.lit(False))


def is_unclassified(c: Column) -> Column:
    """True for a null class and for ``Unclassified`` in any case or padding."""
    return c.isNull() | (F.lower(strip(c)) == UNCLASSIFIED.lower())
