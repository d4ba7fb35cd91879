"""Entries for the report document as a whole."""

from catalog.registry import ENTRIES, add
from parapet.plans import report

#: The entry whose rows a section of the document has.
_SECTIONS = {
    "summary_stats": "a6_summary", "overview_occupancy_counts": "a1_occupancy_counts", "mix_sc_distribution": "a2_mix_distribution",
    "hierarchical_distribution": "a25_hierarchy_views", "hierarchy_bands": "c15_band_texts", "year_occ_flow": "a26_flow_table",
    "year_occ_flow_meta": "a26_flow_meta", "occupancy_hierarchy": "j5_indexed_links", "occupancy_hierarchy_nodes": "a29_node_index",
    "occ_cls_vote_flow": "a28_vote_links", "temporal_data": "a3_annual_series", "pre1940": "a4_historic_summary",
    "pre1940_classes": "a4_historic_classes", "post1940": "a5_decade_classes", "materials_foundation": "a10_era_matrix",
    "materials_foundation_cells": "a9_cell_breakdown", "soil_drainage": "a13_drainage", "soil_flooding": "a14_flooding",
    "soil_water_table": "a15_water_table", "soil_engineering": "a16_engineering", "soil_components": "a17_soil_components",
    "soil_by_occupancy": "a18_soil_by_class", "soil_water_by_occupancy": "a18_water_by_class", "soil_risk": "a19_risk_summary",
    "soil_risk_by_occupancy": "a19_risk_by_class", "cleaning_funnel": "f15_cleaning_funnel", "quality_checks": "f16_quality_checks",
    "unclassified_resolution": "a20_resolution_stats", "unclassified_changed_to": "a20_changed_to", "unclassified_ties": "a21_tie_histogram",
}
_SIZES = {section: ENTRIES[name].sql for section, name in _SECTIONS.items()} | {
    "occ_cls_vote_flow_nodes": "SELECT metric, source AS name FROM vote_links UNION SELECT metric, target FROM vote_links",
}
add("s6_report_sections", "section:t n:n", lambda c: report.section_sizes(c.raw),
    " UNION ALL ".join(f"SELECT '{section}' AS section, (SELECT COUNT(*) FROM ({sql}) AS rows_of) AS n" for section, sql in _SIZES.items()))
add("a33_run_totals", "n:n raw_rows:n", lambda c: _totals(c), "SELECT COUNT(*) AS n, (SELECT COUNT(*) FROM buildings) AS raw_rows FROM prepared")


def _totals(c):
    from pyspark.sql import functions as F
    whole = c.raw_plain.agg(F.count(F.lit(1))).scalar()
    return c.prepared.agg(F.count(F.lit(1)).alias("n")).select("n", whole.alias("raw_rows"))
