"""CSV and Parquet inputs. Types are declared, never inferred by a second read."""

from __future__ import annotations

from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parapet.functions.numbers import null_non_finite, parse_number
from parapet.sources import schema as S


# Words that stand for a missing value.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
_NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|Infinity)\s*$"
_WHOLE = r"^\s*[+-]?\d{1,18}\s*$"


def _files_with_breaks(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The files of ``path`` in which no quoted field spans lines, and the others.

    A field that spans lines leaves an odd number of quotes on the line it starts in, since quotes
    inside a field are doubled. One pass over the lines, itself split into many tasks, finds the
    files with such a line. What reaches the driver are file names, which it lists anyway.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    broken = {unquote(r.file) for r in lines.where(quotes % 2 == 1).select("file").distinct().collect()}
    files = [unquote(f) for f in lines.inputFiles()]
    return [f for f in files if f not in broken], sorted(broken)


def _text_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text: only the header line is read to learn their names.

    Quoted fields may hold line breaks, and the usual words for a missing value become null. A file
    without such breaks is split into many tasks; one with them can only be read by one task.
    """
    reader = spark.read.option("header", True).option("inferSchema", False).option("quote", '"').option("escape", '"')
    plain, broken = _files_with_breaks(spark, path)
    if not broken:
        text = reader.csv(path)
    elif not plain or any(c in f for f in (*plain, *broken) for c in "*?[]{}\\"):
        # Names with the signs of a pattern can't be listed one by one.
        text = reader.option("multiLine", True).csv(path)
    else:
        # The columns are those of the first file's header, as for any folder.
        schema = reader.option("multiLine", True).csv(path).schema
        text = reader.schema(schema).option("multiLine", False).csv(plain).unionAll(reader.schema(schema).option("multiLine", True).csv(broken))
    return text.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in text.columns])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A building table from Parquet: known headers get their short names, non-finite numbers become null."""
    df = null_non_finite(spark.read.parquet(path))
    chosen = S.id_column(df.columns)
    named = df.select(*[F.col(f"`{c}`").alias(S.BUILDING_HEADERS.get(c, c)) for c in df.columns])
    named = named.withColumn("build_id", F.col(f"`{S.BUILDING_HEADERS.get(chosen, chosen)}`"))
    return S.ensure_columns(named, {k: t for k, t in S.BUILDING_TYPES.items() if k != "build_id"})


def _rename_and_type(df: DataFrame, headers: Mapping[str, str]) -> DataFrame:
    """Known headers get their short name and type, the others pass through as text."""
    out = []
    for c in df.columns:
        name = headers.get(c, c)
        column = F.col(f"`{c}`")
        out.append((parse_number(column) if name in S.DOUBLES else column).alias(name))
    return df.select(*out)


def read_buildings(spark: SparkSession, path: str) -> DataFrame:
    """The building table from CSV, with ``build_id`` from the preferred id column."""
    text = _text_csv(spark, path)
    chosen = S.id_column(text.columns)
    typed = _rename_and_type(text, {k: v for k, v in S.BUILDING_HEADERS.items() if v != "build_id"})
    key = F.col(chosen)
    typed = typed.withColumn("build_id", F.coalesce(key.try_cast("bigint").cast("string"), key))
    return S.ensure_columns(typed, {k: t for k, t in S.BUILDING_TYPES.items() if k != "build_id"})


def read_clf(spark: SparkSession, path: str) -> DataFrame | None:
    """The carbon benchmark table, or None when there is no readable file."""
    try:
        return _rename_and_type(_text_csv(spark, path), S.CLF_HEADERS)
    except AnalysisException as problem:
        print(f"{path} skipped: {problem.getCondition()}")
        return None


def read_shoreline(spark: SparkSession, path: str) -> DataFrame:
    """Any columns; the guaranteed ones are added as nulls when missing.

    Columns whose values are all numbers become numbers, whole ones if all are whole; one
    aggregate over the file tells which. Infinities are numbers here.
    """
    text = _text_csv(spark, path)
    columns = [F.col(f"`{c}`") for c in text.columns]
    fits = lambda c, pattern: F.coalesce(F.bool_and(c.rlike(pattern)), F.lit(False))
    told = text.agg(*[x.alias(f"{kind}{i}") for i, c in enumerate(columns) for kind, x in (("n", fits(c, _NUMBER)), ("w", fits(c, _WHOLE)))]).first()
    out = []
    for i, (name, c) in enumerate(zip(text.columns, columns)):
        number = F.regexp_replace(F.trim(c), "(?i)^([+-]?)inf(inity)?$", "$1Infinity").try_cast("double")
        if S.SHORELINE_COLUMNS.get(name, T.StringType()) == T.DoubleType():
            out.append(number.alias(name))
        elif name in S.SHORELINE_COLUMNS or not told[f"n{i}"]:
            out.append(c.alias(name))
        else:
            out.append((F.trim(c).try_cast("bigint") if told[f"w{i}"] else number).alias(name))
    typed = text.select(*out)
    return null_non_finite(S.ensure_columns(typed, S.SHORELINE_COLUMNS), inf=False)


def table_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name and the row count of the table."""
    names = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name")) for i, c in enumerate(df.columns, 1)
    ])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.inline(names), "n_rows")
