"""Entries for the cleaning funnel, predicates and projections."""

from pyspark.sql import functions as F

from catalog.registry import add
from parapet.functions.bands import era
from parapet.functions.numbers import parse_number
from parapet.operators import cleaning, flows, sampling, soil
from parapet.operators.cleaning import CLUSTER_COLUMNS

_YEAR = "year_built>0"
_AREA = f"{_YEAR} AND gfa>0"
_RAW_H = f"{_AREA} AND (height_num IS NULL OR height_num>0)"

add("f1_valid_year", "build_id:n year_built:n", lambda c: c.raw_plain.where(cleaning.valid_year()),
    "SELECT build_id, year_built FROM buildings WHERE year_built>0")
add("f2_valid_area", "build_id:n gfa:n", lambda c: c.raw_plain.where(cleaning.valid_year() & cleaning.valid_area()),
    f"SELECT build_id, gfa FROM buildings WHERE {_AREA}")
add("f3_number_from_text", "build_id:n height:t height_num:n",
    lambda c: c.raw_plain.withColumn("height_num", parse_number(F.col("height"))),
    "SELECT build_id, height, TRY_CAST(height AS DOUBLE) AS height_num FROM buildings")
add("f4_raw_height", "build_id:n height:t height_num:n",
    lambda c: cleaning.with_heights(c.raw_plain).where(cleaning.valid_year() & cleaning.valid_area() & cleaning.valid_raw_height()),
    f"SELECT build_id, height, height_num FROM heights WHERE {_RAW_H}")
add("f5_height_fallback", "build_id:n height_used:n assumed_height:n",
    lambda c: cleaning.with_heights(c.raw_plain),
    "SELECT build_id, height_used, height_used AS assumed_height FROM heights")
add("f6_assumed_height", "build_id:n assumed_height:n", lambda c: c.cleaned_plain,
    f"SELECT build_id, height_used AS assumed_height FROM heights WHERE {_RAW_H} AND height_used>0")


def _outliers(c):
    valid = c.raw_plain.where(cleaning.valid_year() & cleaning.valid_area())
    threshold = cleaning.outlier_threshold(valid)
    return valid.agg(F.count_if(F.col("gfa") > threshold).alias("outliers"), F.count(F.lit(1)).alias("n")).withColumn(
        "threshold", F.lit(threshold))


add("f7_outlier_count", "outliers:n n:n threshold:n", _outliers,
    f"SELECT COUNT(*) FILTER (WHERE gfa>t) AS outliers, COUNT(*) AS n, MIN(t) AS threshold FROM buildings, "
    f"(SELECT quantile_cont(gfa, 0.99999) AS t FROM buildings WHERE {_AREA}) WHERE {_AREA}")
add("f8_drop_outliers", "build_id:n gfa:n", lambda c: cleaning.drop_outliers(cleaning.cluster_table(c.staged)),
    "SELECT build_id, gfa FROM cluster_rows WHERE gfa < (SELECT quantile_cont(gfa, 0.99999) FROM cluster_rows)")
add("f9_complete_cases", "build_id:n " + " ".join(f"{x}:{'t' if x in ('occ_cls', 'material_type', 'foundation_type') else 'n'}" for x in CLUSTER_COLUMNS),
    lambda c: c.cluster, "SELECT * FROM cluster_rows")
add("f10_complete_subset", "build_id:n wtdepannmin:n",
    lambda c: cleaning.complete_cases(c.prepared.select("build_id", "wtdepannmin", *sampling.SAMPLE_REQUIRED), sampling.SAMPLE_REQUIRED),
    "SELECT build_id, wtdepannmin FROM prepared WHERE sqmeters IS NOT NULL AND height_used IS NOT NULL AND year_built IS NOT NULL AND occ_cls IS NOT NULL")
add("f11_era_split", "build_id:n era:t", lambda c: c.cleaned_plain.withColumn("era", era(F.col("year_built"))),
    "SELECT build_id, CASE WHEN year_built<1940 THEN 'pre1940' ELSE 'post1940' END AS era FROM cleaned")
add("f12_class_groups", "occ_cls:t n:n area:n",
    lambda c: c.prepared.where("occ_cls IS NOT NULL").groupBy("occ_cls").agg(F.count(F.lit(1)).alias("n"), F.sum("gfa").alias("area")),
    "SELECT occ_cls, COUNT(*) AS n, SUM(gfa) AS area FROM prepared WHERE occ_cls IS NOT NULL GROUP BY occ_cls")
add("f13_high_risk", "build_id:n high_risk:b", lambda c: c.cleaned_plain.withColumn("high_risk", soil.is_high_risk()),
    "SELECT build_id, COALESCE(drainagecl IN ('Poorly drained','Very poorly drained'),FALSE) OR COALESCE(flodfreqcl IN ('High'),FALSE) AS high_risk FROM cleaned")
add("f14_size_gate", "build_id:n occ_cls:t", lambda c: cleaning.large_groups(c.prepared, "occ_cls", flows.CLASS_MIN_ROWS),
    "SELECT build_id, occ_cls FROM prepared WHERE occ_cls IN (SELECT occ_cls FROM prepared GROUP BY occ_cls HAVING COUNT(*)>100)")

_FUNNEL = {
    "initial_count": "COUNT(*)",
    "initial_columns": "20",
    "invalid_year_count": "COUNT(*) FILTER (WHERE year_built IS NULL OR year_built<=0)",
    "year_negative_or_zero": "COUNT(*) FILTER (WHERE year_built<=0)",
    "year_missing": "COUNT(*) FILTER (WHERE year_built IS NULL)",
    "after_year_filter": f"COUNT(*) FILTER (WHERE {_YEAR})",
    "missing_area_count": f"COUNT(*) FILTER (WHERE {_YEAR} AND (gfa IS NULL OR gfa<=0))",
    "after_missing_area": f"COUNT(*) FILTER (WHERE {_AREA})",
    "area_outliers_count": f"COUNT(*) FILTER (WHERE {_AREA} AND gfa>t)",
    "area_outlier_threshold": "MIN(t)",
    "after_outlier_removal": f"COUNT(*) FILTER (WHERE {_AREA})",
    "invalid_raw_height_count": f"COUNT(*) FILTER (WHERE {_AREA} AND height_num<=0)",
    "invalid_assumed_height_count": f"COUNT(*) FILTER (WHERE {_RAW_H} AND (height_used IS NULL OR height_used<=0))",
    "after_height_filter": f"COUNT(*) FILTER (WHERE {_RAW_H} AND height_used>0)",
    "used_height": f"COUNT(*) FILTER (WHERE {_RAW_H} AND height_used>0 AND height_num IS NOT NULL)",
    "used_pred_height": f"COUNT(*) FILTER (WHERE {_RAW_H} AND height_used>0 AND height_num IS NULL)",
    "final_count": f"COUNT(*) FILTER (WHERE {_RAW_H} AND height_used>0)",
    "total_removed": f"COUNT(*)-COUNT(*) FILTER (WHERE {_RAW_H} AND height_used>0)",
    "removal_percentage": f"ROUND(100.0*(COUNT(*)-COUNT(*) FILTER (WHERE {_RAW_H} AND height_used>0))/COUNT(*),2)",
}
add("f15_cleaning_funnel", " ".join(f"{k}:n" for k in _FUNNEL), lambda c: cleaning.cleaning_funnel(c.raw),
    "SELECT " + ", ".join(f"{v} AS {k}" for k, v in _FUNNEL.items())
    + f" FROM heights, (SELECT quantile_cont(gfa, 0.99999) AS t FROM buildings WHERE {_AREA})")
add("f16_quality_checks", "stage:t negative_gfa:n negative_height:n", lambda c: cleaning.quality_checks(c.raw_plain, c.cleaned_plain),
    "SELECT 'raw' AS stage, COUNT(*) FILTER (WHERE gfa<0) AS negative_gfa, COUNT(*) FILTER (WHERE height_num<0) AS negative_height FROM heights UNION ALL "
    "SELECT 'cleaned', COUNT(*) FILTER (WHERE gfa<0), COUNT(*) FILTER (WHERE height_num<0) FROM cleaned")
add("f17_sample_projection", "build_id:n gfa:n sqmeters:n height_used:n pred_height:n year_built:n occ_cls:t material_type:t foundation_type:t "
    "assumed_height:n drainagecl:t flodfreqcl:t eng_class:t wtdepannmin:n compname:t longitude:n latitude:n",
    lambda c: sampling.sample_base(c.staged), "SELECT * FROM sample_rows")
add("f18_map_points", "build_id:n lon:n lat:n occupancy:t year_built:n area:n drainage:t flooding:t eng_property:t water_table:n compname:t",
    lambda c: sampling.map_points(c.staged),
    "SELECT build_id, longitude AS lon, latitude AS lat, occ_cls AS occupancy, TRUNC(year_built) AS year_built, gfa AS area, drainagecl AS drainage, "
    "flodfreqcl AS flooding, eng_class AS eng_property, wtdepannmin AS water_table, compname FROM "
    "(SELECT * FROM prepared ORDER BY md5(build_id || '#337'), build_id LIMIT 75000) WHERE longitude IS NOT NULL AND latitude IS NOT NULL")
add("f19_positive_only", "metric:t occ_cls:t vote_type:t value:n", lambda c: flows.vote_links(c.prepared), "SELECT * FROM vote_links")
