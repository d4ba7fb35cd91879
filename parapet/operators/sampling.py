"""Exact-size samples and their numbering, reproducible and spread over the cluster.

The order of a sample is that of a hash of the id, so the hash prefix tells almost all
about membership: counting rows per prefix gives the prefix at which the wanted number is
reached. Only rows up to that prefix are sorted, never the table.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parapet.functions.keys import SAMPLE_SEED, sample_key
from parapet.functions.numbers import null_non_finite
from parapet.operators.cleaning import drop_outliers
from parapet.operators.soil import is_high_risk

# Sample and chunk sizes.
RANDOM_ROWS = 75_000
ROWS_PER_CLASS = 2_500
CHUNK_ROWS = 5_000
LIMIT_MB = 25.0
SAMPLE_REQUIRED = ("sqmeters", "height_used", "year_built", "occ_cls")
SAMPLE_COLUMNS = (
    "build_id", "gfa", "sqmeters", "height_used", "pred_height", "year_built", "occ_cls", "material_type",
    "foundation_type", "assumed_height", "drainagecl", "flodfreqcl", "eng_class", "wtdepannmin", "compname",
    "longitude", "latitude",
)
# A cut is fine enough when at most this many rows share its last prefix.
SLACK_ROWS = 50_000
BROADCAST_ROWS = 100_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if its ``rows`` are few; beyond that Spark chooses the join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def prefix_cuts(keys: DataFrame, rows: int, by: str | None = None, digits: int = 2) -> dict[Any, str]:
    """Per group the smallest prefix whose rows, with all smaller prefixes, reach ``rows``.

    ``keys`` has a column ``key``. Groups that do not reach ``rows`` are absent. A pass
    counts at most 16**digits prefixes per group and returns one row per group; a crowded
    prefix is refined by another pass over the rows of that prefix alone.
    """
    group = F.col(by) if by else F.lit("")
    source = keys.select(group.alias("g"), "key").where("g IS NOT NULL")
    schema = T.StructType([T.StructField("g", source.schema["g"].dataType), T.StructField("prefix", T.StringType()), T.StructField("missing", T.LongType())])
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("p"))
    scoped, depth = source.withColumn("missing", F.lit(rows).cast("bigint")), 0
    cuts: dict[Any, str] = {}
    while True:
        depth += digits
        counted = scoped.groupBy("g", "missing", F.substring("key", 1, depth).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        left = counted.withColumn("left", F.col("missing") - (upto - F.col("n")))
        found = left.where(F.col("left").between(1, F.col("n"))).select("g", "p", "n", "left").collect()
        cuts.update({r.g if by else None: r.p for r in found})
        crowded = [(r.g, r.p, r.left) for r in found if r.n - r.left > SLACK_ROWS and depth < 32]
        if not crowded:
            return cuts
        table = keys.sparkSession.createDataFrame(crowded, schema)
        scoped = source.join(_small(table, len(crowded)), "g").where(F.col("key").startswith(F.col("prefix"))).drop("prefix")


def _keyed(df: DataFrame, id_column: str, seed: int) -> DataFrame:
    return df.withColumn("_key", sample_key(F.col(id_column), seed))


def random_sample(df: DataFrame, rows: int = RANDOM_ROWS, id_column: str = "build_id", seed: int = SAMPLE_SEED) -> DataFrame:
    """Exactly ``rows`` rows (all when there are fewer), the first in hash order."""
    keyed = _keyed(df, id_column, seed)
    cut = prefix_cuts(keyed.select(F.col("_key").alias("key")), rows, digits=3).get(None)
    if cut is None:
        return df
    near = keyed.where(F.substring("_key", 1, len(cut)) <= cut)
    return near.orderBy("_key", id_column).limit(rows).drop("_key")


def stratified_sample(
    df: DataFrame, by: str = "occ_cls", rows: int = ROWS_PER_CLASS, id_column: str = "build_id", seed: int = SAMPLE_SEED
) -> DataFrame:
    """At most ``rows`` rows per class, null classes left out.

    Rows beyond a class's prefix are filtered before the shuffle, so the ranking of even
    the largest class sees little more than ``rows`` rows.
    """
    keyed = _keyed(df.where(F.col(by).isNotNull()), id_column, seed)
    cuts = prefix_cuts(keyed.select(by, F.col("_key").alias("key")), rows, by=by)
    schema = T.StructType([T.StructField(by, df.schema[by].dataType), T.StructField("_cut", T.StringType())])
    table = _small(df.sparkSession.createDataFrame(list(cuts.items()), schema), len(cuts))
    near = keyed.join(table, by, "left").where("_cut IS NULL OR substring(_key, 1, length(_cut)) <= _cut").select(*keyed.columns)
    order = Window.partitionBy(by).orderBy("_key", id_column)
    ranked = near.withColumn("_rank", F.row_number().over(order))
    return ranked.where(F.col("_rank") <= rows).drop("_rank", "_key")


def sample_base(df: DataFrame) -> DataFrame:
    """The rows samples are drawn from: complete in the required columns and below the area outliers."""
    chosen = df.select(*[c for c in SAMPLE_COLUMNS if c in df.columns]).dropna("any", subset=list(SAMPLE_REQUIRED))
    return drop_outliers(chosen, "gfa")


def map_points(df: DataFrame, rows: int = RANDOM_ROWS) -> DataFrame:
    """The map sample; rows without a position are dropped after drawing, as they were drawn."""
    return random_sample(df, rows).dropna("any", subset=["longitude", "latitude"]).select(
        "build_id",
        F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), F.col("occ_cls").alias("occupancy"),
        F.col("year_built").cast("bigint").alias("year_built"), F.col("gfa").alias("area"),
        F.col("drainagecl").alias("drainage"), F.col("flodfreqcl").alias("flooding"),
        F.col("eng_class").alias("eng_property"), F.col("wtdepannmin").alias("water_table"), "compname",
    )


def risk_points(df: DataFrame, rows: int = RANDOM_ROWS) -> DataFrame:
    """Map points of the sample with the high-risk flag."""
    flagged = random_sample(df.withColumn("high_risk", is_high_risk()), rows)
    return flagged.dropna("any", subset=["longitude", "latitude"]).select(
        "build_id", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), "occ_cls", "high_risk"
    )


def numbered(df: DataFrame, id_column: str = "build_id", by: str | None = None, seed: int = SAMPLE_SEED, digits: int = 3) -> DataFrame:
    """Add ``sample_index``: 0, 1, 2 … in hash order, per value of ``by`` when given.

    The number is the count of rows in smaller prefixes plus the rank inside the prefix, so
    the sort is spread over up to 16**digits groups and does not depend on partitioning.
    The offsets are one row per prefix; the ranking is already dealt by the keys they are joined on.
    """
    group = by or "_all"
    keyed = _keyed(df, id_column, seed).withColumn("_prefix", F.substring("_key", 1, digits))
    if by is None:
        keyed = keyed.withColumn("_all", F.substring("_key", 1, 0))
    counts = keyed.groupBy(group, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_prefix", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_prefix").orderBy("_key", id_column)
    ranked = keyed.withColumn("_rank", F.row_number().over(inside)).join(offsets, [group, "_prefix"])
    index = F.col("_offset") + F.col("_rank") - 1
    return ranked.withColumn("sample_index", index).drop("_key", "_prefix", "_rank", "_offset", "_all")


def chunked(df: DataFrame, size: int = CHUNK_ROWS, **kwargs: Any) -> DataFrame:
    """:func:`numbered` with the 1-based chunk of ``size`` rows each row belongs to."""
    return numbered(df, **kwargs).withColumn("chunk_index", F.floor(F.col("sample_index") / size) + 1)


def _manifest(sized: DataFrame, prefix: str, limit_mb: float, size: int) -> DataFrame:
    """The manifest of (type, chunk_index, sample_count, size_bytes) rows."""
    mb = F.col("size_bytes") / (1024 * 1024)
    return sized.select(
        F.format_string(f"{prefix}_samples_%s_%d.json", "type", "chunk_index").alias("filename"),
        "type", "chunk_index", "sample_count", "size_bytes", F.round(mb, 2).alias("size_mb"),
        (mb > limit_mb).alias("too_large"),
        F.when(mb > limit_mb, F.floor(F.lit(size * 20) / mb)).alias("suggested_chunk_rows"),
    )


def chunk_manifest(chunks: DataFrame, prefix: str = "building_data", limit_mb: float = LIMIT_MB, size: int = CHUNK_ROWS) -> DataFrame:
    """One row per chunk before it is written: file name, rows, size its file will have, and a warning.

    The size is that of the records as :func:`parapet.sources.writers.write_chunks` writes
    them, line ends included. A chunk above ``limit_mb`` gets the chunk size that would bring
    it to 20 MB.
    """
    finite = null_non_finite(chunks)
    record = F.to_json(F.struct(*[c for c in chunks.columns if c not in ("type", "chunk_index")]), {"ignoreNullFields": "false"})
    summed = finite.select("type", "chunk_index", F.octet_length(record).alias("_b")).groupBy("type", "chunk_index").agg(
        F.count(F.lit(1)).alias("sample_count"), F.sum(F.col("_b") + 1).alias("size_bytes")
    )
    return _manifest(summed, prefix, limit_mb, size)


def written_manifest(spark: SparkSession, path: str, prefix: str = "building_data", limit_mb: float = LIMIT_MB, size: int = CHUNK_ROWS) -> DataFrame:
    """:func:`chunk_manifest` of the chunks that lie below ``path``: sizes from the file system, rows from the files' lines.

    Read after the write is committed, so it tells what is there. Only the listing is needed for sizes; the
    records are counted by line and not parsed.
    """
    place = "type string, chunk_index bigint"
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/type=*")
    if not pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern):
        return _manifest(spark.createDataFrame([], f"{place}, sample_count bigint, size_bytes bigint"), prefix, limit_mb, size)
    sizes = spark.read.format("binaryFile").load(path).groupBy("type", F.col("chunk_index").cast("bigint").alias("chunk_index")).agg(F.sum("length").alias("size_bytes"))
    lines = spark.read.schema(f"value string, {place}").text(path)
    counts = lines.groupBy("type", "chunk_index").agg(F.count(F.lit(1)).alias("sample_count"))
    return _manifest(sizes.join(counts, ["type", "chunk_index"]), prefix, limit_mb, size)
