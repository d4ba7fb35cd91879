"""Entries for reading, schema repair and JSON output."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.registry import Inputs, add
from parapet.functions.numbers import null_non_finite
from parapet.operators import crosstab, sampling
from parapet.sources import readers, standin, writers
from parapet.sources.schema import ensure_columns
from parapet.staging import shared_folder

_NAMES = [*standin.BUILDING_EXPRESSIONS, "occ_dict"]
add("s1_scan_buildings", "position:n column_name:t n_rows:n", lambda c: readers.table_profile(c.raw),
    "SELECT position, column_name, (SELECT COUNT(*) FROM buildings) AS n_rows FROM (VALUES "
    + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_NAMES, 1)) + ") AS names(position, column_name)")

add("s2_clf_source", "build_id:n gfa:n occ_cls:t material_type:t mass_total:n gwp_a_to_c:n str_sys_summary:t general_fnd_type:t",
    lambda c: c.clf, "SELECT * FROM clf")

add("s3_shoreline_source", "build_id:n latitude:n longitude:n occ_cls:t material_type:t year_built:n",
    lambda c: c.shoreline, "SELECT * FROM shoreline")

add("s4_ensure_columns", "build_id:n latitude:n longitude:n occ_cls:t material_type:t foundation_type:t year_built:n",
    lambda c: ensure_columns(c.shoreline, {
        "latitude": T.DoubleType(), "longitude": T.DoubleType(), "occ_cls": T.StringType(),
        "material_type": T.StringType(), "foundation_type": T.StringType(), "year_built": T.DoubleType(),
    }),
    "SELECT *, CAST(NULL AS VARCHAR) AS foundation_type FROM shoreline")


def _records(c: Inputs):
    """Rows to JSON text and back; a null field must still be spelled out in the text."""
    frame = c.shoreline.select("build_id", "occ_cls", "material_type", "year_built", "latitude")
    text = frame.select(writers.as_records(frame).alias("record"))
    parsed = text.select("record", F.from_json("record", frame.schema).alias("r"))
    spelled = F.col("record").contains('"year_built":')
    return parsed.select("r.*", spelled.alias("spelled_out"))


add("s5_json_records", "build_id:n occ_cls:t material_type:t year_built:n latitude:n spelled_out:b", _records,
    "SELECT build_id, occ_cls, material_type, year_built, latitude, TRUE AS spelled_out FROM shoreline")


def sample_chunks(c: Inputs):
    """The random and the balanced sample, each numbered and cut into chunks."""
    base = sampling.sample_base(c.staged)
    random = sampling.random_sample(base).withColumn("type", F.lit("random"))
    balanced = sampling.stratified_sample(base).withColumn("type", F.lit("balanced"))
    return sampling.chunked(random.unionByName(balanced), by="type")


add("s7_sample_chunks", "type:t build_id:n sample_index:n chunk_index:n", sample_chunks,
    "SELECT type, build_id, sample_index, chunk_index FROM sample_chunks")

#: So low that full chunks are above it and the last ones are not.
_LIMIT_MB = 1.5


def _written(c: Inputs):
    """The manifest of the chunks after they are written, from the files."""
    chunks = sample_chunks(c).select("type", "chunk_index", *_RECORD)
    path = f"{shared_folder(c.spark)}/chunks-{uuid.uuid4().hex}"
    writers.write_chunks(chunks, path)
    return sampling.written_manifest(c.spark, path, limit_mb=_LIMIT_MB)


_RECORD = ("build_id", "gfa", "sqmeters", "height_used", "year_built", "occ_cls", "material_type", "foundation_type", "drainagecl", "flodfreqcl", "eng_class", "wtdepannmin", "compname", "sample_index")
_TWIN = (
    "SELECT 'building_data_samples_' || type || '_' || CAST(CAST(chunk_index AS INT) AS VARCHAR) || '.json' AS filename, type, chunk_index, sample_count, size_bytes, "
    f"ROUND(size_bytes/1048576.0, 2) AS size_mb, size_bytes/1048576.0 > {_LIMIT_MB} AS too_large, "
    f"CASE WHEN size_bytes/1048576.0 > {_LIMIT_MB} THEN FLOOR({20 * sampling.CHUNK_ROWS}/(size_bytes/1048576.0)) END AS suggested_chunk_rows FROM ("
    "SELECT type, chunk_index, COUNT(*) AS sample_count, SUM(strlen(to_json({" + ", ".join(f"'{c}': {c}" for c in _RECORD) + "})) + 1) AS size_bytes "
    "FROM (SELECT r.*, c.type, c.chunk_index, c.sample_index FROM sample_chunks c JOIN sample_rows r USING (build_id)) GROUP BY type, chunk_index)"
)
_MANIFEST = "filename:t type:t chunk_index:n sample_count:n size_bytes:n size_mb:n too_large:b suggested_chunk_rows:n"
add("s8_chunk_manifest", _MANIFEST, lambda c: sampling.chunk_manifest(sample_chunks(c).select("type", "chunk_index", *_RECORD), limit_mb=_LIMIT_MB), _TWIN)
add("s8_written_manifest", _MANIFEST, _written, _TWIN)

_ODD = "CASE k%5 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN CAST('-Infinity' AS DOUBLE) ELSE p END"


def _odd(c: Inputs):
    orders = standin.table(c.spark, c.folder, "orders").selectExpr(*standin.ORDER_ALIASES)
    return orders.selectExpr("k AS build_id", f"{_ODD} AS value").withColumn("listed", F.array("value", F.lit(1.5)))


add("s9_finite_or_null", "build_id:n value:n first:n second:n",
    lambda c: null_non_finite(_odd(c)).select("build_id", "value", F.col("listed")[0].alias("first"), F.col("listed")[1].alias("second")),
    "SELECT k AS build_id, CASE WHEN k%5>2 THEN p END AS value, CASE WHEN k%5>2 THEN p END AS first, 1.5 AS second FROM order_base")

add("s11_nan_to_null", "build_id:n value:n infinite:b",
    lambda c: null_non_finite(_odd(c), inf=False).select(
        "build_id", F.when(F.abs("value") < float("inf"), F.col("value")).alias("value"),
        F.coalesce(F.abs("value") == float("inf"), F.lit(False)).alias("infinite")),
    "SELECT k AS build_id, CASE WHEN k%5>2 THEN p END AS value, k%5 IN (1,2) AS infinite FROM order_base")


def _clf_document(c: Inputs):
    """All sections of the carbon benchmark document in one long table."""
    maps = crosstab.clf_heatmaps(c.clf)
    cells = F.array(*[
        F.struct(F.lit(part).alias("measure"), F.col(column).cast("double").alias("value"))
        for part, column in (("count", "n"), ("gfa", "area"))
    ])
    heat = maps.select(F.col("heatmap").alias("section"), F.col("row").alias("y"), F.col("foundation").alias("x"), F.inline(cells))
    values = F.array(*[
        F.struct(F.lit(m).alias("x"), F.lit("value").alias("measure"), F.col(m).alias("value"))
        for m in ("gfa", "mass_total", "gwp_a_to_c")
    ])
    scatter = crosstab.clf_scatter(c.clf).select(F.lit("scatter").alias("section"), F.col("build_id").cast("string").alias("y"), F.inline(values))
    return heat.unionByName(scatter)


add("s10_clf_document", "section:t y:t x:t measure:t value:n", _clf_document,
    "SELECT heatmap AS section, row AS y, foundation AS x, 'count' AS measure, CAST(n AS DOUBLE) AS value FROM clf_grid UNION ALL "
    "SELECT heatmap, row, foundation, 'gfa', area FROM clf_grid UNION ALL "
    "SELECT 'scatter', CAST(build_id AS VARCHAR), x, 'value', v FROM (SELECT build_id, UNNEST(['gfa','mass_total','gwp_a_to_c']) AS x, UNNEST([gfa, mass_total, gwp_a_to_c]) AS v "
    "FROM clf WHERE gfa IS NOT NULL AND mass_total IS NOT NULL AND gwp_a_to_c IS NOT NULL AND occ_cls IS NOT NULL AND material_type IS NOT NULL AND str_sys_summary IS NOT NULL)")
