"""Stand-in inputs: the same columns as the real tables, derived from the TPC-H style ones.

One order is one building and its lines are the votes inside it. The expressions are
plain SQL valid in Spark and DuckDB alike, so a checker can build the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# k = order key, c = customer key, p = price, st = status, pr = priority.
ORDER_ALIASES = (
    "o_orderkey AS k", "o_custkey AS c", "o_totalprice AS p", "o_orderstatus AS st", "o_orderpriority AS pr",
)
VOTE_ORDER = ("AGR", "COM", "EDU", "GOV", "IND", "REL", "RES")
BUILDING_EXPRESSIONS = {
    "build_id": "k",
    "year_built": "CAST(CASE WHEN k%53=0 THEN NULL WHEN k%59=0 THEN 0 WHEN k%61=0 THEN -1 ELSE 1900+(c*7+k)%125 END AS DOUBLE)",
    "gfa": "CAST(CASE WHEN k%47=0 THEN NULL WHEN k%67=0 THEN 0 ELSE FLOOR(p/100) END AS DOUBLE)",
    "sqmeters": "CAST(CASE WHEN k%101=0 THEN NULL ELSE FLOOR(p/(100*(1+k%3))) END AS DOUBLE)",
    "height": "CASE WHEN k%7=0 THEN NULL WHEN k%41=0 THEN 'n/a' WHEN k%43=0 THEN '0' WHEN k%71=0 THEN '-3.5' ELSE CAST(3+(k*13+c)%60 AS VARCHAR(10)) END",
    "pred_height": "CAST(CASE WHEN k%31=0 THEN NULL WHEN k%37=0 THEN 0 ELSE 3+(k*17+c)%40 END AS DOUBLE)",
    "occ_cls": "CASE WHEN k%29=0 THEN NULL WHEN k%23<2 THEN 'Unclassified' WHEN c%20<9 THEN 'Residential' WHEN c%20<12 THEN 'Commercial' WHEN c%20<14 THEN 'Industrial' WHEN c%20=14 THEN 'Agriculture' WHEN c%20=15 THEN 'Assembly' WHEN c%20=16 THEN 'Education' WHEN c%20=17 THEN 'Government' ELSE 'Utility' END",
    "prim_occ": "CASE WHEN k%73=0 THEN NULL WHEN pr='4-NOT SPECIFIED' THEN 'Unclassified' ELSE pr END",
    "mix_sc": "CASE k%4 WHEN 1 THEN 'MIX_SC1' WHEN 2 THEN 'MIX_SC2' WHEN 3 THEN 'MIX_SC3' END",
    "material_type": "CASE WHEN k%11=0 THEN NULL WHEN st='F' THEN 'W' WHEN st='O' THEN 'S' ELSE 'M' END",
    "foundation_type": "CASE WHEN k%13=0 THEN NULL WHEN c%3=0 THEN 'Slab' WHEN c%3=1 THEN 'Crawl' ELSE 'Basement' END",
    "drainagecl": "CASE (c+k)%7 WHEN 0 THEN 'Well drained' WHEN 1 THEN 'Moderately well drained' WHEN 2 THEN 'Somewhat poorly drained' WHEN 3 THEN 'Poorly drained' WHEN 4 THEN 'Very poorly drained' WHEN 5 THEN 'Excessively drained' END",
    "flodfreqcl": "CASE k%10 WHEN 0 THEN 'High' WHEN 1 THEN 'Occasional' WHEN 2 THEN 'Rare' WHEN 3 THEN NULL ELSE 'None' END",
    "eng_property": "CASE WHEN k%17=0 THEN NULL ELSE CAST((k*3+c)%50 AS DOUBLE)/100 END",
    "wtdepannmin": "CAST(CASE WHEN k%19=0 THEN NULL ELSE (c*11+k)%200 END AS DOUBLE)",
    "compname": "CASE WHEN k%17=3 THEN NULL ELSE CONCAT('Soil_',CAST((c+k*3)%40 AS VARCHAR(10))) END",
    "mukey": "CONCAT('MU',CAST((c+k*3)%40 AS VARCHAR(10)))",
    "longitude": "CAST((c*31+k)%3600 AS DOUBLE)/1000-73.5E0",
    "latitude": "CAST((c*17+k*7)%1600 AS DOUBLE)/1000+41.2E0",
}
CLF_EXPRESSIONS = {
    "build_id": "build_id",
    "gfa": "gfa",
    "occ_cls": "occ_cls",
    "material_type": "material_type",
    "mass_total": "CASE WHEN build_id%7=0 THEN NULL ELSE gfa*900+build_id%1000 END",
    "gwp_a_to_c": "CASE WHEN build_id%11=0 THEN NULL ELSE gfa*400+build_id%1000 END",
    "str_sys_summary": "CASE WHEN build_id%13=0 THEN NULL WHEN material_type='W' THEN 'Wood: Mass Timber' WHEN build_id%3=0 THEN 'Steel/Concrete' ELSE 'Steel' END",
    "general_fnd_type": "CASE foundation_type WHEN 'Slab' THEN 'Shallow foundation' WHEN 'Crawl' THEN 'Shallow foundation' WHEN 'Basement' THEN 'Deep foundation' END",
}
PERMIT_EXPRESSIONS = {
    "permit_id": "event_id",
    "permit_ts": "ts",
    "longitude": "CAST((event_id*37)%3600 AS DOUBLE)/1000-73.5E0+0.0001E0",
    "latitude": "CAST((event_id*53)%1600 AS DOUBLE)/1000+41.2E0+0.0001E0",
}
SOIL_EXPRESSIONS = {
    "cokey": "p_partkey",
    "mukey": "CONCAT('MU',CAST(p_partkey%40 AS VARCHAR(10)))",
    "compname": "CONCAT('Soil_',CAST(p_partkey%55 AS VARCHAR(10)))",
    "comppct_r": "p_size",
}
# A hexagon per nation: centre from the key, corners at fixed offsets (lon, lat).
LAND_CENTRE = ("CAST((n_nationkey*577)%3400 AS DOUBLE)/1000-73.4E0", "CAST((n_nationkey*331)%1400 AS DOUBLE)/1000+41.3E0")
LAND_CORNERS = ((0.09, 0.01), (0.05, 0.08), (-0.04, 0.07), (-0.1, -0.01), (-0.05, -0.08), (0.06, -0.07))
# Half the side of a building's footprint box, in degrees.
FOOTPRINT_HALF = 0.00003


def _select(expressions: dict[str, str]) -> list[str]:
    return [f"{text} AS {name}" for name, text in expressions.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vote_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vote string per order, counted from its lines."""
    counts = [f"COUNT_IF(l_partkey%7={i}) AS v{i}" for i in range(len(VOTE_ORDER))]
    pieces = [x for i, code in enumerate(VOTE_ORDER)
              for x in (F.lit(f"{', ' if i else ''}{code}: "), F.col(f"v{i}").cast("string"))]
    per_order = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.expr(c) for c in counts])
    return per_order.select(F.col("l_orderkey").alias("build_id"), F.concat(*pieces).alias("occ_dict"))


def buildings(spark: SparkSession, sf_dir: str, votes: bool = True) -> DataFrame:
    """The building table; without ``votes`` the vote string is a typed null and costs no join."""
    base = table(spark, sf_dir, "orders").selectExpr(*ORDER_ALIASES).selectExpr(*_select(BUILDING_EXPRESSIONS))
    if votes:
        return base.join(vote_texts(spark, sf_dir), "build_id", "left")
    return base.withColumn("occ_dict", F.lit(None).cast("string"))


def clf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buildings(spark, sf_dir, votes=False).selectExpr(*_select(CLF_EXPRESSIONS))


def shoreline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buildings(spark, sf_dir, votes=False).drop("foundation_type")


def nsi_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed point per order line (the line key repeats in the raw table)."""
    lines = (
        table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_partkey").alias("part"))
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.selectExpr(
        "l_orderkey*10+l_linenumber AS point_id",
        "CAST(part%7 AS INT) AS type_no",
        "CAST((o_custkey*31+l_orderkey)%3600 AS DOUBLE)/1000-73.5E0+(l_linenumber-4)*0.00002E0 AS longitude",
        "CAST((o_custkey*17+l_orderkey*7)%1600 AS DOUBLE)/1000+41.2E0 AS latitude",
    )


def permits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_select(PERMIT_EXPRESSIONS))


def soil_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*_select(SOIL_EXPRESSIONS))


def land_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """polygon_id and its corners as array<struct<lon,lat>>."""
    lon, lat = (F.expr(e) for e in LAND_CENTRE)
    corners = F.array(*[F.struct((lon + dx).alias("lon"), (lat + dy).alias("lat")) for dx, dy in LAND_CORNERS])
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("polygon_id"), corners.alias("corners"))
