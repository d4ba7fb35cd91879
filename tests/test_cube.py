"""The label cube: every report from its views equals the one from the buildings, and reads no buildings."""

import pytest
from catalog.registry import Inputs
from parapet.functions.bands import ENG_LABELS
from parapet.functions.numbers import WEIGHT
from parapet.operators import classes, crosstab, cube, distribution, flows, soil, temporal
from parapet.plans import report
from parapet.sources import standin


@pytest.fixture(scope="module")
def tables(spark, data):
    return report.Tables.of(standin.buildings(spark, data))


#: Each section from the buildings themselves.
PLAIN = {
    "summary_stats": lambda t: temporal.summary(t.prepared),
    "overview_occupancy_counts": lambda t: distribution.value_counts(t.prepared, "occ_cls", "occ_cls"),
    "mix_sc_distribution": lambda t: distribution.mix_distribution(t.prepared),
    "year_occ_flow": lambda t: flows.flow_table(t.prepared),
    "year_occ_flow_meta": lambda t: flows.flow_meta(t.prepared),
    "temporal_data": lambda t: temporal.annual_series(t.cluster),
    "pre1940": lambda t: temporal.historic_summary(t.prepared),
    "pre1940_classes": lambda t: temporal.historic_classes(t.prepared),
    "post1940": lambda t: temporal.decade_classes(t.prepared),
    "materials_foundation": lambda t: crosstab.era_matrix(t.prepared),
    "materials_foundation_cells": lambda t: crosstab.cell_breakdown(t.prepared),
    "soil_drainage": lambda t: distribution.value_shares(t.prepared, "drainagecl"),
    "soil_flooding": lambda t: distribution.value_shares(t.prepared, "flodfreqcl"),
    "soil_engineering": lambda t: distribution.value_shares(t.prepared, "eng_class", ENG_LABELS),
    "soil_components": lambda t: soil.component_ranking(t.prepared),
    "soil_by_occupancy": lambda t: soil.soil_by_class(t.prepared),
    "soil_risk": lambda t: soil.risk_summary(t.prepared),
    "soil_risk_by_occupancy": lambda t: soil.risk_by_class(t.prepared),
    "unclassified_resolution": lambda t: classes.resolution_stats(t.prepared),
    "unclassified_changed_to": lambda t: classes.changed_to(t.prepared),
    "unclassified_ties": lambda t: classes.tie_histogram(t.prepared),
    "occupancy_hierarchy_nodes": lambda t: flows.node_index(flows.class_use_links(t.prepared).selectExpr("*", "'class_use' AS diagram"), "diagram", "occ_cls", "prim_occ"),
}


def _bag(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_section_from_the_cube(tables, name):
    mine, plain = report.REPORTS[name](tables), PLAIN[name](tables)
    assert mine.columns == plain.columns and mine.dtypes == plain.dtypes
    assert _bag(mine) == _bag(plain)
    assert "prepared-" not in mine._jdf.queryExecution().executedPlan().toString()


def test_sets_and_null_labels(spark, data):
    """A null label and a column that is not in the set are told apart; weights add up to the table in every set."""
    prepared = Inputs(spark, data).prepared
    made = cube.label_cube(prepared).cache()
    n = prepared.count()
    for name in cube.SETS:
        found = cube.view(made, name)
        assert found.agg({WEIGHT: "sum"}).first()[0] == n, name
        assert found.count() == prepared.selectExpr(*[_expression(c) for c in cube.SETS[name]]).distinct().count(), name
    made.unpersist()


def _expression(column):
    return {
        "_complete": " AND ".join(f"{c} IS NOT NULL" for c in cube.CLUSTER_COLUMNS) + " AS c", "_has_votes": "occ_dict IS NOT NULL AS v",
        "year_band": "CASE WHEN year_built < 1940 THEN 1 WHEN year_built < 1980 THEN 2 ELSE 3 END AS y",
    }.get(column, column)


def test_empty_table(spark, data):
    raw = standin.buildings(spark, data).limit(0)
    t = report.Tables.of(raw)
    assert report.REPORTS["summary_stats"](t).first().total_buildings == 0
    assert report.REPORTS["pre1940"](t).first().total_count == 0 and report.REPORTS["year_occ_flow"](t).count() == 0
