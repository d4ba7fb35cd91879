"""Entries for distributions, crosstabs, flows, annual series, soil reports and rankings."""

from functools import reduce

from pyspark.sql import functions as F

from catalog.registry import Inputs, add
from parapet.functions.bands import ENG_LABELS
from parapet.operators import classes, cleaning, crosstab, distribution, flows, sampling, soil, temporal
from parapet.staging import stage

_KNOWN = "FROM prepared WHERE occ_cls IS NOT NULL"

# --- counts -------------------------------------------------------------------------------
add("a1_occupancy_counts", "occ_cls:t n:n", lambda c: distribution.value_counts(c.prepared, "occ_cls", "occ_cls"),
    f"SELECT occ_cls, COUNT(*) AS n {_KNOWN} GROUP BY occ_cls")
add("a2_mix_distribution", "label:t n:n", lambda c: distribution.mix_distribution(c.prepared),
    "SELECT CASE WHEN mix_sc IS NULL THEN 'Same Type Only' WHEN mix_sc='MIX_SC1' THEN '1 Conflict Type (MIX_SC1)' WHEN mix_sc='MIX_SC2' THEN 'Same & Different Types (MIX_SC2)' "
    "ELSE '>1 Conflict Types (MIX_SC3)' END AS label, COUNT(*) AS n FROM prepared GROUP BY 1")
add("a3_annual_series", "year:n display_year:t occ_cls:t n:n avg_area:n total_area:n", lambda c: temporal.annual_series(c.cluster),
    "SELECT TRUNC(year_built) AS year, CASE WHEN year_built<1940 THEN 'pre-1940' ELSE CAST(CAST(year_built AS BIGINT) AS VARCHAR) END AS display_year, "
    "occ_cls, COUNT(*) AS n, AVG(gfa) AS avg_area, SUM(gfa) AS total_area FROM cluster_rows GROUP BY 1,2,3")
add("a4_historic_summary", "total_count:n residential_count:n non_residential_count:n percentage_of_total:n", lambda c: temporal.historic_summary(c.prepared),
    "SELECT COUNT(*) FILTER (WHERE year_built<1940) AS total_count, COUNT(*) FILTER (WHERE year_built<1940 AND occ_cls='Residential') AS residential_count, "
    "COUNT(*) FILTER (WHERE year_built<1940 AND occ_cls<>'Residential') AS non_residential_count, ROUND(100.0*COUNT(*) FILTER (WHERE year_built<1940)/COUNT(*),2) AS percentage_of_total FROM prepared")
add("a4_historic_classes", "occ_cls:t n:n", lambda c: temporal.historic_classes(c.prepared),
    f"SELECT occ_cls, COUNT(*) AS n {_KNOWN} AND year_built<1940 GROUP BY occ_cls")
add("a5_decade_classes", "decade:t occ_cls:t n:n total:n", lambda c: temporal.decade_classes(c.prepared),
    "SELECT * FROM (SELECT CAST(CAST(FLOOR(year_built/10)*10 AS BIGINT) AS VARCHAR) || 's' AS decade, occ_cls, COUNT(*) AS n, SUM(COUNT(*)) OVER (PARTITION BY FLOOR(year_built/10)) AS total "
    "FROM prepared WHERE year_built>=1940 AND year_built<2030 GROUP BY FLOOR(year_built/10), occ_cls) WHERE occ_cls IS NOT NULL")
add("a6_summary", "total_buildings:n avg_year_built:n avg_area_sqm:n min_year:n max_year:n occupancy_classes:t", lambda c: temporal.summary(c.prepared),
    "SELECT COUNT(*) AS total_buildings, TRUNC(AVG(year_built)) AS avg_year_built, AVG(gfa) AS avg_area_sqm, MIN(year_built) AS min_year, MAX(year_built) AS max_year, "
    "(SELECT string_agg(occ_cls, '|' ORDER BY occ_cls) FROM (SELECT DISTINCT occ_cls FROM prepared WHERE occ_cls IS NOT NULL)) AS occupancy_classes FROM prepared")

# --- crosstabs ----------------------------------------------------------------------------
_GRID = ("SELECT r.era, r.material_type, f.foundation_type, COUNT(x.build_id) AS n, COALESCE(SUM(x.gfa),0) AS area FROM (SELECT DISTINCT era, material_type FROM era_cells) r "
         "JOIN (SELECT DISTINCT era, foundation_type FROM era_cells) f USING (era) LEFT JOIN era_cells x ON x.era=r.era AND x.material_type=r.material_type AND x.foundation_type=f.foundation_type GROUP BY 1,2,3")
add("a7_crosstab_counts", "material_type:t foundation_type:t n:n",
    lambda c: crosstab.era_matrix(c.prepared).where("era='all'"),
    f"SELECT material_type, foundation_type, n FROM ({_GRID}) WHERE era='all'")
add("a8_crosstab_area", "material_type:t foundation_type:t area:n",
    lambda c: crosstab.matrix(c.prepared, "material_type", "foundation_type"),
    f"SELECT material_type, foundation_type, area FROM ({_GRID}) WHERE era='all'")
# Years by soil component: a matrix of which many cells are empty.
_YEARS = "SELECT CAST(year_built AS BIGINT) AS year, compname, build_id, gfa FROM prepared WHERE compname IS NOT NULL"
add("a8_sparse_area", "year:n compname:t n:n area:n",
    lambda c: crosstab.matrix(c.prepared.withColumn("year", F.col("year_built").cast("bigint")), "year", "compname"),
    f"SELECT r.year, f.compname, COUNT(x.build_id) AS n, COALESCE(SUM(x.gfa),0) AS area FROM (SELECT DISTINCT year FROM ({_YEARS})) r, (SELECT DISTINCT compname FROM ({_YEARS})) f "
    f"LEFT JOIN ({_YEARS}) x ON x.year=r.year AND x.compname=f.compname GROUP BY 1,2")
add("a9_cell_breakdown", "era:t material_type:t foundation_type:t level:t occ_cls:t n:n area:n cell:t", lambda c: crosstab.cell_breakdown(c.prepared),
    "SELECT era, material_type, foundation_type, 'total' AS level, NULL AS occ_cls, COUNT(*) AS n, SUM(gfa) AS area, material_type || '_' || foundation_type AS cell FROM era_cells GROUP BY ALL UNION ALL "
    "SELECT era, material_type, foundation_type, 'class', occ_cls, COUNT(*), SUM(gfa), material_type || '_' || foundation_type FROM era_cells WHERE occ_cls IS NOT NULL GROUP BY ALL")
add("a10_era_matrix", "era:t material_type:t foundation_type:t n:n area:n", lambda c: crosstab.era_matrix(c.prepared), _GRID)
add("a11_clf_heatmaps", "heatmap:t row:t foundation:t n:n area:n", lambda c: crosstab.clf_heatmaps(c.clf), "SELECT * FROM clf_grid")
add("a12_clf_scatter", "build_id:n gfa:n mass_total:n gwp_a_to_c:n occ_cls:t material_type:t str_sys_summary:t", lambda c: crosstab.clf_scatter(c.clf),
    "SELECT * FROM clf WHERE gfa IS NOT NULL AND mass_total IS NOT NULL AND gwp_a_to_c IS NOT NULL AND occ_cls IS NOT NULL AND material_type IS NOT NULL AND str_sys_summary IS NOT NULL")
add("j3_dense_matrix", "heatmap:t row:t foundation:t n:n",
    lambda c: crosstab.dense(crosstab.clf_cells(c.clf), "heatmap", "row", "foundation", ("n",)), "SELECT heatmap, row, foundation, n FROM clf_grid")
add("t5_crosstab_axes", "era:t axis:t label:t position:n",
    lambda c: crosstab.axes(crosstab.era_matrix(c.prepared), "era", "material_type", "foundation_type"),
    "SELECT era, 'row' AS axis, material_type AS label, ROW_NUMBER() OVER (PARTITION BY era ORDER BY material_type)-1 AS position FROM (SELECT DISTINCT era, material_type FROM era_cells) UNION ALL "
    "SELECT era, 'column', foundation_type, ROW_NUMBER() OVER (PARTITION BY era ORDER BY foundation_type)-1 FROM (SELECT DISTINCT era, foundation_type FROM era_cells)")

# --- soil ---------------------------------------------------------------------------------
_SHARES = ("SELECT COALESCE({0},'NaN (Missing)') AS value, COUNT(*) AS n, 100.0*COUNT(*)/(SELECT COUNT(*) FROM prepared) AS pct FROM prepared GROUP BY 1")
add("a13_drainage", "value:t n:n pct:n", lambda c: distribution.value_shares(c.prepared, "drainagecl"), _SHARES.format("drainagecl"))
add("a14_flooding", "value:t n:n pct:n", lambda c: distribution.value_shares(c.prepared, "flodfreqcl"), _SHARES.format("flodfreqcl"))
add("a15_water_table", "mean:n median:n std:n min:n max:n q25:n q75:n", lambda c: soil.water_table_stats(c.staged),
    "SELECT AVG(wtdepannmin) AS mean, quantile_cont(wtdepannmin,0.5) AS median, STDDEV_SAMP(wtdepannmin) AS std, MIN(wtdepannmin) AS min, MAX(wtdepannmin) AS max, "
    "quantile_cont(wtdepannmin,0.25) AS q25, quantile_cont(wtdepannmin,0.75) AS q75 FROM prepared")
add("a16_engineering", "value:t n:n pct:n", lambda c: distribution.value_shares(c.prepared, "eng_class", ENG_LABELS), _SHARES.format("eng_class"))
_SOILS = "SELECT COALESCE(compname,'NaN (Missing)') AS value, COUNT(*) AS n FROM prepared GROUP BY 1"
add("a17_soil_components", "value:t n:n pct:n total_unique:n top_coverage:n", lambda c: soil.component_ranking(c.prepared),
    f"SELECT value, n, 100.0*n/(SELECT COUNT(*) FROM prepared) AS pct, (SELECT COUNT(*) FROM ({_SOILS})) AS total_unique, "
    f"(SELECT 100.0*SUM(n) FROM (SELECT n FROM ({_SOILS}) WHERE value<>'NaN (Missing)' ORDER BY n DESC, value LIMIT 20))/(SELECT COUNT(*) FROM prepared) AS top_coverage "
    f"FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY value='NaN (Missing)' ORDER BY n DESC, value) AS r FROM ({_SOILS})) WHERE r<=20")


def _by_class(what: str, column: str) -> str:
    return f"SELECT '{what}' AS what, occ_cls, COALESCE({column},'NaN (Missing)') AS value, COUNT(*) AS n {_KNOWN} GROUP BY ALL"


_TOP10 = (f"SELECT what, occ_cls, value, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY occ_cls, value='NaN (Missing)' ORDER BY n DESC, value) AS r FROM ({_by_class('components', 'compname')})) WHERE r<=10")
_ENG = ("SELECT 'engineering' AS what, k.occ_cls, l.value, COUNT(p.build_id) AS n FROM (SELECT DISTINCT occ_cls FROM prepared WHERE occ_cls IS NOT NULL) k, "
        "(VALUES ('Favorable'),('Fair'),('Poor'),('Very poor')) AS l(value) LEFT JOIN prepared p ON p.occ_cls=k.occ_cls AND p.eng_class=l.value GROUP BY ALL UNION ALL "
        f"SELECT 'engineering', occ_cls, 'NaN (Missing)', COUNT(*) {_KNOWN} AND eng_class IS NULL GROUP BY occ_cls")
add("a18_soil_by_class", "what:t occ_cls:t value:t n:n", lambda c: soil.soil_by_class(c.prepared),
    f"{_by_class('drainage', 'drainagecl')} UNION ALL {_by_class('flooding', 'flodfreqcl')} UNION ALL {_ENG} UNION ALL {_TOP10}")
add("a18_water_by_class", "occ_cls:t mean:n median:n std:n", lambda c: soil.water_table_by_class(c.staged),
    f"SELECT occ_cls, AVG(wtdepannmin) AS mean, quantile_cont(wtdepannmin,0.5) AS median, STDDEV_SAMP(wtdepannmin) AS std {_KNOWN} AND wtdepannmin IS NOT NULL GROUP BY occ_cls")
_RISK = "(drainagecl IN ('Poorly drained','Very poorly drained') OR flodfreqcl='High')"
add("a19_risk_summary", "high_risk_count:n high_risk_percentage:n high_risk_avg_year:n high_risk_total_area:n", lambda c: soil.risk_summary(c.prepared),
    f"SELECT COUNT(*) AS high_risk_count, ROUND(100.0*COUNT(*)/(SELECT COUNT(*) FROM prepared),2) AS high_risk_percentage, TRUNC(AVG(year_built)) AS high_risk_avg_year, SUM(gfa) AS high_risk_total_area FROM prepared WHERE {_RISK}")
add("a19_risk_by_class", "occ_cls:t n:n", lambda c: soil.risk_by_class(c.prepared),
    f"SELECT occ_cls, COUNT(*) AS n {_KNOWN} AND {_RISK} GROUP BY occ_cls")

# --- class repair -------------------------------------------------------------------------
add("a20_resolution_stats", "total_unclassified_before:n with_occdict:n changed:n unchanged:n mix_sc_recalculated:n", lambda c: classes.resolution_stats(c.resolved),
    "SELECT COUNT(outcome) AS total_unclassified_before, COUNT(*) FILTER (WHERE outcome IS NOT NULL AND occ_dict IS NOT NULL) AS with_occdict, COUNT(*) FILTER (WHERE outcome='changed') AS changed, "
    "COUNT(*) FILTER (WHERE outcome<>'changed') AS unchanged, COUNT(*) FILTER (WHERE occ_cls_orig='Unclassified' AND occ_cls<>'Unclassified') AS mix_sc_recalculated FROM resolved")
add("a20_changed_to", "occ_cls:t n:n", lambda c: classes.changed_to(c.resolved),
    "SELECT vote_class AS occ_cls, COUNT(*) AS n FROM resolved WHERE outcome='changed' GROUP BY 1")
add("a21_tie_histogram", "tie:t n:n", lambda c: classes.tie_histogram(c.resolved),
    "SELECT tie, COUNT(*) AS n FROM resolved WHERE tie IS NOT NULL GROUP BY tie")
add("a22_reclass_map", "build_id:n code:t", lambda c: classes.reclass_map(c.resolved),
    "SELECT build_id, first_code AS code FROM (SELECT r.build_id, MIN(b.code) AS first_code FROM resolved r JOIN ballots b ON b.build_id=r.build_id AND b.cls=r.vote_class WHERE r.outcome='changed' GROUP BY r.build_id)")
add("a23_mix_recalculated", "mix_sc_recalculated:n", lambda c: classes.needs_mix(c.resolved).agg(F.count(F.lit(1)).alias("mix_sc_recalculated")),
    "SELECT COUNT(*) AS mix_sc_recalculated FROM resolved WHERE occ_cls_orig='Unclassified' AND outcome='changed'")


# --- flows --------------------------------------------------------------------------------
def _links(c: Inputs):
    edges = flows.terciles(c.staged)
    return flows.hierarchy_links(flows.hierarchy_cube(c.staged, edges))


_PAIR = "step:n source:t target:t value:n"
add("a24_hierarchy_links", f"metric:t {_PAIR}", lambda c: _links(c).where("scope='all' AND detail='full'"),
    "SELECT * FROM hierarchy WHERE scope='all' AND detail='full'")
add("a25_hierarchy_views", f"scope:t detail:t metric:t {_PAIR}", _links, "SELECT * FROM hierarchy")
add("a26_flow_table", "year_band:t occupancy:t material:t foundation:t soil:t count:n gfa:n", lambda c: flows.flow_table(c.prepared),
    "SELECT year_band, COALESCE(occ_cls,'Unknown') AS occupancy, material, foundation, soil, COUNT(*) AS count, SUM(gfa) AS gfa FROM flow_rows GROUP BY 1,2,3,4,5")
add("a26_flow_grouped", "year_band:t occupancy:t material:t foundation:t soil:t count:n gfa:n",
    lambda c: flows.flow_table(c.prepared, top_classes=5, top_soils=10, group_others=True),
    "SELECT * FROM (SELECT year_band, CASE WHEN cr<=5 THEN f.occ_cls ELSE 'Other' END AS occupancy, material, foundation, CASE WHEN sr<=10 THEN f.soil ELSE 'Other Soils' END AS soil, COUNT(*) AS count, SUM(gfa) AS gfa "
    "FROM flow_rows f JOIN (SELECT occ_cls, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, occ_cls NULLS LAST) AS cr FROM flow_rows GROUP BY occ_cls) k ON f.occ_cls IS NOT DISTINCT FROM k.occ_cls "
    "JOIN (SELECT soil, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, soil) AS sr FROM flow_rows GROUP BY soil) s ON f.soil=s.soil GROUP BY ALL) WHERE occupancy IS NOT NULL")
add("a26_flow_meta", "total_buildings:n levels:t year_order:t occupancy_grouping:t soil_grouping:t", lambda c: flows.flow_meta(c.prepared),
    "SELECT COUNT(*) AS total_buildings, 'All Buildings > Year > Occupancy > Material > Foundation > Soil' AS levels, 'Historic (<1940) > Mid-Century (1940–1980) > Modern (>1980)' AS year_order, "
    "'raw' AS occupancy_grouping, 'raw' AS soil_grouping FROM prepared")
add("a27_class_use_links", "source:t target:t value:n", lambda c: flows.class_use_links(c.prepared), "SELECT source, target, value FROM use_links")
add("a28_vote_links", "metric:t source:t target:t value:n", lambda c: flows.vote_links(c.prepared), "SELECT metric, source, target, value FROM vote_links")
add("a29_hierarchy_nodes", "scope:t detail:t metric:t name:t level:n", lambda c: flows.hierarchy_nodes(_links(c)),
    "SELECT scope, detail, metric, name, CASE WHEN MIN(level)=0 THEN 0 ELSE MAX(level) END AS level FROM (SELECT scope, detail, metric, source AS name, step-1 AS level FROM hierarchy UNION ALL "
    "SELECT scope, detail, metric, target, step FROM hierarchy) GROUP BY 1,2,3,4")


def _use_links(c: Inputs):
    return flows.class_use_links(c.prepared).withColumn("diagram", F.lit("class_use"))


_USE_NODES = ("SELECT name, ROW_NUMBER() OVER (ORDER BY side, a, b)-1 AS idx FROM (SELECT 0 AS side, source AS name, MIN(occ_cls) AS a, '' AS b FROM use_links GROUP BY source UNION ALL "
              "SELECT 1, target, MIN(occ_cls), MIN(prim_occ) FROM use_links GROUP BY target)")
add("a29_node_index", "name:t idx:n", lambda c: flows.node_index(_use_links(c), "diagram", "occ_cls", "prim_occ"), _USE_NODES)


def _indexed(c: Inputs):
    # One row per pair of labels, read three times.
    links = stage(_use_links(c), "links")
    return flows.indexed_links(links, flows.node_index(links, "diagram", "occ_cls", "prim_occ"), "diagram")


add("j5_indexed_links", "source_idx:n target_idx:n value:n", _indexed,
    f"SELECT s.idx AS source_idx, t.idx AS target_idx, value FROM use_links l JOIN ({_USE_NODES}) s ON l.source=s.name JOIN ({_USE_NODES}) t ON l.target=t.name")
add("j1_flow_measures", "year_band:t material:t count:n gfa:n",
    lambda c: flows.flow_table(c.prepared).groupBy("year_band", "material").agg(F.sum("count").alias("count"), F.sum("gfa").alias("gfa")),
    "SELECT a.year_band, a.material, count, COALESCE(gfa,0) AS gfa FROM (SELECT year_band, material, COUNT(*) AS count FROM flow_rows GROUP BY 1,2) a "
    "LEFT JOIN (SELECT year_band, material, SUM(gfa) AS gfa FROM flow_rows GROUP BY 1,2) b ON a.year_band=b.year_band AND a.material=b.material")
add("j4_top_n_membership", "build_id:n soil:t",
    lambda c: distribution.recode_rare(c.prepared, "compname", 15, "Other Soils", "soil"),
    "SELECT build_id, CASE WHEN compname IN (SELECT compname FROM prepared WHERE compname IS NOT NULL GROUP BY compname ORDER BY COUNT(*) DESC, compname LIMIT 15) THEN compname ELSE 'Other Soils' END AS soil FROM prepared")

# --- distinct values, set operations and rankings ------------------------------------------
add("a31_most_frequent", "occ_cls:t material:t",
    lambda c: distribution.most_frequent(c.prepared.where("occ_cls IS NOT NULL"), ["occ_cls"], "material_type", "material"),
    f"SELECT occ_cls, material_type AS material FROM (SELECT occ_cls, material_type, ROW_NUMBER() OVER (PARTITION BY occ_cls ORDER BY COUNT(*) DESC, material_type) AS r {_KNOWN} AND material_type IS NOT NULL GROUP BY 1,2) WHERE r=1")
add("a32_distinct_classes", "occ_cls:t", lambda c: distribution.distinct_values(c.prepared, "occ_cls"), "SELECT DISTINCT occ_cls FROM prepared")
add("u1_unique_labels", "name:t", lambda c: _ends(flows.vote_links(c.prepared)), "SELECT source AS name FROM vote_links UNION SELECT target FROM vote_links")
add("u2_node_names", "name:t", lambda c: _ends(_links(c)), "SELECT source AS name FROM hierarchy UNION SELECT target FROM hierarchy")
add("u3_node_lists", "side:t name:t", lambda c: _sides(flows.class_use_links(c.prepared)),
    "SELECT DISTINCT 'class' AS side, source AS name FROM use_links UNION ALL SELECT DISTINCT 'use', target FROM use_links")


def _ends(links):
    return links.select(F.col("source").alias("name")).union(links.select("target")).distinct()


def _sides(links):
    left = links.select(F.lit("class").alias("side"), F.col("source").alias("name")).distinct()
    return left.unionByName(links.select(F.lit("use").alias("side"), F.col("target").alias("name")).distinct())


def _tops(c: Inputs):
    picks = ((9, "occ_cls"), (12, "occ_cls"), (15, "compname"), (20, "compname"))
    parts = [distribution.top_values(c.prepared, col, k).withColumn("k", F.lit(k)) for k, col in picks]
    return reduce(lambda a, b: a.unionByName(b), parts)


add("t1_top_k", "k:n value:t n:n", _tops, " UNION ALL ".join(
    f"SELECT * FROM (SELECT {k} AS k, {col} AS value, COUNT(*) AS n FROM prepared WHERE {col} IS NOT NULL GROUP BY {col} ORDER BY n DESC, value LIMIT {k})"
    for k, col in ((9, "occ_cls"), (12, "occ_cls"), (15, "compname"), (20, "compname"))))
add("t2_top_k_per_class", "occ_cls:t value:t n:n",
    lambda c: distribution.group_value_counts(c.prepared, "occ_cls", "compname", top_k=10), f"SELECT occ_cls, value, n FROM ({_TOP10})")
add("t3_by_frequency", "value:t n:n", lambda c: distribution.by_frequency(distribution.value_counts(c.prepared, "prim_occ"), "value"),
    "SELECT prim_occ AS value, COUNT(*) AS n FROM prepared WHERE prim_occ IS NOT NULL GROUP BY 1 ORDER BY n DESC, value")
add("t4_sorted_classes", "classes:t",
    lambda c: c.prepared.agg(F.array_join(F.sort_array(F.collect_set("occ_cls")), "|").alias("classes")),
    "SELECT string_agg(occ_cls, '|' ORDER BY occ_cls) AS classes FROM (SELECT DISTINCT occ_cls FROM prepared WHERE occ_cls IS NOT NULL)")

# --- samples ------------------------------------------------------------------------------
add("p1_random_sample", "build_id:n gfa:n", lambda c: sampling.random_sample(sampling.sample_base(c.staged)), "SELECT build_id, gfa FROM random_rows")
add("p1_random_sample_2500", "build_id:n gfa:n", lambda c: sampling.random_sample(sampling.sample_base(c.staged), 2500),
    "SELECT build_id, gfa FROM sample_rows ORDER BY hkey, build_id LIMIT 2500")
add("p2_stratified_sample", "build_id:n occ_cls:t", lambda c: sampling.stratified_sample(sampling.sample_base(c.staged)), "SELECT build_id, occ_cls FROM balanced_rows")

# --- annual views -------------------------------------------------------------------------
add("d9_normalised_series", "year:n occ_cls:t n:n share:n", lambda c: temporal.normalised_series(c.prepared),
    "SELECT year, occ_cls, n, n/SUM(n) OVER (PARTITION BY year) AS share FROM year_counts")
add("d10_cumulative_series", "year:n occ_cls:t n:n running:n", lambda c: temporal.cumulative_series(c.prepared),
    "SELECT year, occ_cls, n, SUM(n) OVER (PARTITION BY occ_cls ORDER BY year) AS running FROM year_counts")
add("d11_stacked_series", "year:n occ_cls:t n:n total_area:n", lambda c: temporal.annual_series(c.cluster.where("year_built >= 1940")),
    "SELECT TRUNC(year_built) AS year, occ_cls, COUNT(*) AS n, SUM(gfa) AS total_area FROM cluster_rows WHERE year_built>=1940 GROUP BY 1,2")


add("d12_building_type", "kind:t n:n area:n", lambda c: cleaning.building_type_totals(c.prepared),
    "SELECT 'All' AS kind, COUNT(*) AS n, SUM(gfa) AS area FROM prepared UNION ALL SELECT 'Residential', COUNT(*), SUM(gfa) FROM prepared WHERE occ_cls='Residential' UNION ALL "
    "SELECT 'Non-Residential', COUNT(*), SUM(gfa) FROM prepared WHERE occ_cls<>'Residential'")
add("d13_floor_area_trend", "year:n total_area:n", lambda c: temporal.floor_area_trend(c.prepared), "SELECT TRUNC(year_built) AS year, SUM(gfa) AS total_area FROM prepared GROUP BY 1")
add("d14_area_weighted", "occ_cls:t year_built_weighted:n height_used_weighted:n wtdepannmin_weighted:n",
    lambda c: temporal.area_weighted(c.prepared, "occ_cls", ("year_built", "height_used", "wtdepannmin")),
    f"SELECT occ_cls, SUM(year_built*gfa)/SUM(gfa) AS year_built_weighted, SUM(height_used*gfa)/SUM(gfa) AS height_used_weighted, "
    f"SUM(wtdepannmin*gfa)/SUM(CASE WHEN wtdepannmin IS NOT NULL THEN gfa END) AS wtdepannmin_weighted {_KNOWN} GROUP BY occ_cls")
add("d15_material_evolution", "year:n material_type:t n:n total_area:n", lambda c: temporal.material_evolution(c.prepared),
    "SELECT TRUNC(year_built) AS year, material_type, COUNT(*) AS n, SUM(gfa) AS total_area FROM prepared WHERE year_built>=1940 AND year_built<2025 AND material_type IS NOT NULL GROUP BY 1,2")
add("d16_risk_points", "build_id:n lon:n lat:n occ_cls:t high_risk:b", lambda c: sampling.risk_points(c.staged),
    f"SELECT build_id, longitude AS lon, latitude AS lat, occ_cls, COALESCE({_RISK},FALSE) AS high_risk FROM (SELECT * FROM prepared ORDER BY md5(build_id || '#337'), build_id LIMIT 75000) WHERE longitude IS NOT NULL AND latitude IS NOT NULL")
