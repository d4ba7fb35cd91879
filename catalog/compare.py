"""Run entries in Spark and their SQL in DuckDB and compare the rows as unordered bags."""

from __future__ import annotations

import math
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from catalog.registry import ENTRIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return db


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    return value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, db: duckdb.DuckDBPyConnection, folder: str, name: str) -> dict:
    entry = ENTRIES[name]
    started = time.time()
    df = entry.run(spark, folder)
    rows = df.collect()
    result = {"name": name, "rows": len(rows), "spark_s": round(time.time() - started, 2), "match": None}
    if entry.sql is None:
        return result
    started = time.time()
    cursor = db.execute(entry.sql)
    columns = [d[0] for d in cursor.description]
    twin = cursor.fetchall()
    result["sql_s"] = round(time.time() - started, 2)
    mine, other = _bag(df.columns, rows), _bag(columns, twin)
    result["match"] = sorted(df.columns) == sorted(columns) and mine == other
    if not result["match"]:
        result["sql_rows"] = len(twin)
        result["only_spark"] = list((mine - other).items())[:3]
        result["only_sql"] = list((other - mine).items())[:3]
    return result
