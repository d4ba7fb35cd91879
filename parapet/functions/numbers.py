"""Number clean-up: text to number, non-finite to null, percentages, truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the characters a number written as text may consist of.
NUMBER_CHARACTERS = "0123456789+-.eE \t\r\n"


# Of a row that stands for many buildings: their number, and the sum of their years.
WEIGHT, YEARS = "_rows", "_years"


def counted(df: DataFrame, condition: Column | None = None) -> Column:
    """The number of buildings (that meet a condition): of rows, or of what weighted rows stand for."""
    if WEIGHT not in df.columns:
        return F.count(F.lit(1)) if condition is None else F.count_if(condition)
    weight = F.col(WEIGHT) if condition is None else F.when(condition, F.col(WEIGHT))
    return F.coalesce(F.sum(weight), F.lit(0).cast("bigint"))


def mean_year(df: DataFrame, condition: Column | None = None) -> Column:
    """The mean year of construction of the buildings (that meet a condition)."""
    only = lambda c: c if condition is None else F.when(condition, c)
    if WEIGHT not in df.columns:
        return F.avg(only(F.col("year_built")))
    return F.try_divide(F.sum(only(F.col(YEARS))), F.sum(only(F.col(WEIGHT))))


def mean_area(df: DataFrame) -> Column:
    """The mean floor area; weighted rows carry the sum."""
    return F.try_divide(F.sum("gfa"), F.sum(WEIGHT)) if WEIGHT in df.columns else F.avg("gfa")


def finite_or_null(c: Column, inf: bool = True) -> Column:
    """NaN becomes null; the infinities as well unless ``inf`` is false."""
    bad = F.isnan(c)
    if inf:
        bad = bad | (F.abs(c) == float("inf"))
    return F.when(~bad, c)


def parse_number(c: Column) -> Column:
    """Text to double. Anything that is not a plain finite number becomes null.

    The character test guards the cast, which would also take Java's ``1d``, ``1f`` and
    hexadecimal forms; it is much cheaper than a pattern.
    """
    return F.when(F.translate(c, NUMBER_CHARACTERS, "") == "", finite_or_null(c.try_cast("double")))


def as_number(df: DataFrame, column: str) -> Column:
    """A column as finite double, parsed only when it is text."""
    is_text = isinstance(df.schema[column].dataType, T.StringType)
    return parse_number(F.col(column)) if is_text else finite_or_null(F.col(column).cast("double"))


def percent(part: Column, whole: Column, scale: int | None = 2) -> Column:
    """``part`` of ``whole`` in percent; null when there is no whole."""
    share = F.try_divide(part * F.lit(100.0), whole)
    return share if scale is None else F.round(share, scale)


def truncate(c: Column) -> Column:
    """Drop the fraction, toward zero."""
    return c.cast("bigint")


def _clean(c: Column, dtype: T.DataType, inf: bool) -> Column | None:
    """The cleaned column, or None when ``dtype`` holds no floating point value."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return finite_or_null(c, inf)
    if isinstance(dtype, T.ArrayType):
        if _clean(F.lit(None), dtype.elementType, inf) is None:
            return None
        return F.transform(c, lambda x: _clean(x, dtype.elementType, inf))
    if isinstance(dtype, T.MapType):
        if _clean(F.lit(None), dtype.valueType, inf) is None:
            return None
        return F.transform_values(c, lambda _, v: _clean(v, dtype.valueType, inf))
    if isinstance(dtype, T.StructType):
        parts = [(f.name, _clean(c.getField(f.name), f.dataType, inf)) for f in dtype.fields]
        if all(p is None for _, p in parts):
            return None
        cleaned = F.struct(*[(c.getField(n) if p is None else p).alias(n) for n, p in parts])
        return F.when(c.isNotNull(), cleaned)
    return None


def null_non_finite(df: DataFrame, inf: bool = True) -> DataFrame:
    """NaN (and, by default, the infinities) to null in every column, nested ones included."""
    cleaned = {f.name: _clean(F.col(f"`{f.name}`"), f.dataType, inf) for f in df.schema.fields}
    return df.withColumns({n: c for n, c in cleaned.items() if c is not None})
