import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parapet.functions import bands as B
from parapet.functions.numbers import null_non_finite, parse_number, percent
from parapet.sources.schema import ensure_columns, id_column


def _band(spark, values, make):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    return [r[0] for r in df.select(make(F.col("v"))).collect()]


def test_year_bands(spark):
    got = _band(spark, [-1.0, 0.0, 1939.0, 1940.0, 1980.0, None, math.inf], lambda c: B.year_band(c, ("a", "b", "c")))
    assert got == [None, "a", "a", "b", "c", None, None]


def test_engineering_bands_are_right_closed(spark):
    got = _band(spark, [0.17, 0.18, 0.24, 0.32, 0.33, None, -math.inf, math.inf], B.engineering_class)
    assert got == ["Favorable", "Fair", "Fair", "Poor", "Very poor", None, None, "Very poor"]


def test_equal_quantile_edges_leave_the_middle_empty(spark):
    assert _band(spark, [5.0, 4.0], lambda c: B.tercile_band(c, 5.0, 5.0, B.AREA_LABELS)) == ["Large", "Small"]


def test_year_labels(spark):
    df = spark.createDataFrame([(1939.0,), (1940.0,), (2024.0,)], "y double")
    assert [tuple(r) for r in df.select(B.display_year(F.col("y")), B.decade_label(F.col("y"))).collect()] == [
        ("pre-1940", "1930s"), ("1940", "1940s"), ("2024", "2020s")]


def test_numbers_from_text(spark):
    df = spark.createDataFrame([(x,) for x in ["12", " 3.5 ", "-3.5", "1e3", "n/a", "1d", "1f", "0x10", "nan", "inf", "", None, "1-2"]], "t string")
    assert [r[0] for r in df.select(parse_number(F.col("t"))).collect()] == [12.0, 3.5, -3.5, 1000.0] + [None] * 9


def test_non_finite_values_become_null_at_any_depth(spark):
    schema = T.StructType([
        T.StructField("a", T.DoubleType()), T.StructField("b", T.ArrayType(T.DoubleType())),
        T.StructField("c", T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.StringType())])),
        T.StructField("d", T.MapType(T.StringType(), T.DoubleType())), T.StructField("e", T.LongType()),
    ])
    rows = [(math.nan, [math.inf, 1.0], (-math.inf, "k"), {"m": math.nan}, 1), (1.5, None, None, None, None)]
    got = null_non_finite(spark.createDataFrame(rows, schema)).collect()
    assert got[0].a is None and got[0].b == [None, 1.0] and got[0].c.x is None and got[0].c.y == "k" and got[0].d == {"m": None}
    assert got[1].a == 1.5 and got[1].b is None and got[1].c is None
    kept = null_non_finite(spark.createDataFrame(rows, schema), inf=False).collect()
    assert kept[0].a is None and kept[0].b == [math.inf, 1.0]


def test_percent_without_a_whole_is_null(spark):
    row = spark.range(1).select(percent(F.lit(1), F.lit(8)), percent(F.lit(1), F.lit(0))).first()
    assert row[0] == 12.5 and row[1] is None


def test_ensure_columns_and_id(spark):
    df = ensure_columns(spark.range(1), {"id": T.LongType(), "x": T.DoubleType()})
    assert df.schema["x"].dataType == T.DoubleType() and df.columns == ["id", "x"]
    assert id_column(["fid", "OBJECTID"]) == "OBJECTID"
    with pytest.raises(ValueError):
        id_column(["name"])
