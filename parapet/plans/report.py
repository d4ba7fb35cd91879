"""The report document: every report of the building table, written as data sets and one JSON summary.

The prepared table is written once. Reports on labels read one cube of it, made in a single pass; the few
others read it pruned to their columns.
Reports whose size depends on labels only go into the summary; samples and maps stay data sets.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.functions import votes
from parapet.functions.bands import ENG_LABELS
from parapet.functions.numbers import null_non_finite
from parapet.operators import classes, cleaning, clustering, crosstab, cube, distribution, flows, sampling, soil, temporal
from parapet.plans import buildings as plan
from parapet.sources import writers
from parapet.staging import cleared, stage

VERSION = "3.2"
# A larger section stays a data set, and the summary names its place.
SUMMARY_ROWS = 200_000


@dataclass
class Tables:
    """The staged inputs of the reports. What several reports share is made once, when the first one asks for it."""

    raw: DataFrame
    prepared: DataFrame
    cluster: DataFrame

    @staticmethod
    def of(raw: DataFrame) -> Tables:
        prepared = stage(plan.prepared(raw), "prepared")
        return Tables(raw, prepared, cleaning.cluster_table(prepared))

    @cached_property
    def cube(self) -> DataFrame:
        return stage(cube.label_cube(self.prepared), "label-cube")

    def view(self, name: str) -> DataFrame:
        return cube.view(self.cube, name)

    @cached_property
    def edges(self) -> flows.Terciles | None:
        return flows.terciles(self.prepared)

    @cached_property
    def class_uses(self) -> DataFrame:
        # Links are one row per pair of labels; links, their numbers and their names all read them.
        return stage(flows.class_use_links(self.view("use")).withColumn("diagram", F.lit("class_use")), "links")

    @cached_property
    def vote_links(self) -> DataFrame:
        return stage(flows.vote_links(self.prepared), "links")


def _indexed(links: DataFrame, diagram: str, first: str, second: str) -> DataFrame:
    return flows.indexed_links(links, flows.node_index(links, diagram, first, second), diagram)


REPORTS: dict[str, Callable[[Tables], DataFrame]] = {
    "summary_stats": lambda t: temporal.summary(t.view("years")),
    "overview_occupancy_counts": lambda t: distribution.value_counts(t.view("years"), "occ_cls", "occ_cls"),
    "mix_sc_distribution": lambda t: distribution.mix_distribution(t.view("mix")),
    "hierarchical_distribution": lambda t: flows.hierarchy_links(flows.hierarchy_cube(t.prepared, t.edges)),
    "hierarchy_bands": lambda t: flows.band_descriptions(t.prepared, t.edges),
    "year_occ_flow": lambda t: flows.flow_table(t.view("flow")),
    "year_occ_flow_meta": lambda t: flows.flow_meta(t.view("mix")),
    "occupancy_hierarchy": lambda t: _indexed(t.class_uses, "diagram", "occ_cls", "prim_occ"),
    "occupancy_hierarchy_nodes": lambda t: flows.node_index(t.class_uses, "diagram", "occ_cls", "prim_occ"),
    "occ_cls_vote_flow": lambda t: _indexed(t.vote_links, "metric", "occ_cls", "vote_type"),
    "occ_cls_vote_flow_nodes": lambda t: flows.node_index(t.vote_links, "metric", "occ_cls", "vote_type"),
    "temporal_data": lambda t: temporal.annual_series(t.view("years").where(cube.COMPLETE)),
    "pre1940": lambda t: temporal.historic_summary(t.view("years")),
    "pre1940_classes": lambda t: temporal.historic_classes(t.view("years")),
    "post1940": lambda t: temporal.decade_classes(t.view("years")),
    "materials_foundation": lambda t: crosstab.era_matrix(t.view("years")),
    "materials_foundation_cells": lambda t: crosstab.cell_breakdown(t.view("years")),
    "soil_drainage": lambda t: distribution.value_shares(t.view("soil"), "drainagecl"),
    "soil_flooding": lambda t: distribution.value_shares(t.view("soil"), "flodfreqcl"),
    "soil_water_table": lambda t: soil.water_table_stats(t.prepared),
    "soil_engineering": lambda t: distribution.value_shares(t.view("engineering"), "eng_class", ENG_LABELS),
    "soil_components": lambda t: soil.component_ranking(t.view("flow")),
    "soil_by_occupancy": lambda t: soil.ranked_counts(cube.soil_counts(t.cube)),
    "soil_water_by_occupancy": lambda t: soil.water_table_by_class(t.prepared),
    "soil_risk": lambda t: soil.risk_summary(t.view("soil")),
    "soil_risk_by_occupancy": lambda t: soil.risk_by_class(t.view("soil")),
    "cleaning_funnel": lambda t: cleaning.cleaning_funnel(t.raw),
    "quality_checks": lambda t: cleaning.quality_checks(t.raw, t.prepared),
    "unclassified_resolution": lambda t: classes.resolution_stats(t.view("repair")),
    "unclassified_changed_to": lambda t: classes.changed_to(t.view("repair")),
    "unclassified_ties": lambda t: classes.tie_histogram(t.view("repair")),
}


def _main_analysis(t: Tables) -> DataFrame:
    return clustering.cluster_analysis(clustering.main_clusters(t.cluster).staged_labels())


def _elbow(t: Tables) -> DataFrame:
    rows = cleaning.complete_cases(t.prepared.select("build_id", "occ_cls", "gfa", "year_built"))
    return clustering.elbow_clusters(cleaning.drop_outliers(rows)).wcss()


CLUSTER_REPORTS: dict[str, Callable[[Tables], DataFrame]] = {
    "clustering": _main_analysis,
    "clustering_elbow": _elbow,
    "occupancy_clusters": lambda t: clustering.plain_clusters(t.prepared).statistics(with_area=True),
    "occupancy_clusters_enhanced": lambda t: clustering.feature_clusters(t.prepared).statistics(dominant=True),
}


def section_sizes(raw: DataFrame) -> DataFrame:
    """Rows per section of the report document, without writing anything."""
    t = Tables.of(raw)
    parts = [build(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("section"), "n") for name, build in REPORTS.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def samples(prepared: DataFrame, with_labels: bool = True) -> DataFrame:
    """The random and the balanced sample with their cluster labels, numbered and cut into chunks."""
    base = sampling.sample_base(prepared)
    parts = []
    for kind, sample in (("random", sampling.random_sample(base)), ("balanced", sampling.stratified_sample(base))):
        drawn = stage(sample, f"{kind}-sample")
        labelled = clustering.sample_label_columns(clustering.sample_clusters(drawn), drawn) if with_labels else drawn
        parts.append(labelled.withColumn("type", F.lit(kind)))
    return sampling.chunked(parts[0].unionByName(parts[1], allowMissingColumns=True), by="type")


def _rows(df: DataFrame, place: str) -> list[dict] | dict:
    """A report as plain records, or where it lies if it is too large for that."""
    rows = null_non_finite(df).limit(SUMMARY_ROWS + 1).collect()
    if len(rows) > SUMMARY_ROWS:
        return {"path": place}
    return [row.asDict(recursive=True) for row in rows]


def write_report(raw: DataFrame, folder: str, source: str = "", clusters: bool = True) -> dict:
    """Write all sections below ``folder`` and return the summary document.

    ``sections/<name>`` holds every report as JSON Lines, ``samples`` the chunks,
    ``map_points`` and ``reclass_map`` the two large data sets. Intermediate tables are deleted at the end.
    """
    with cleared(raw.sparkSession):
        return _write_report(raw, folder, source, clusters)


def _write_report(raw: DataFrame, folder: str, source: str, clusters: bool) -> dict:
    t = Tables.of(raw)
    document: dict = {}
    for name, build in {**REPORTS, **(CLUSTER_REPORTS if clusters else {})}.items():
        report = build(t)
        path = f"{folder}/sections/{name}"
        writers.write_records(report, path)
        # Read back what was written instead of running the report a second time.
        document[name] = _rows(raw.sparkSession.read.schema(report.schema).json(path), path)
    writers.write_records(sampling.map_points(t.prepared), f"{folder}/map_points")
    writers.write_records(classes.reclass_map(t.prepared), f"{folder}/reclass_map")
    writers.write_chunks(samples(t.prepared, with_labels=clusters), f"{folder}/samples")
    # A manifest has a row for every 5,000 sample rows, and samples have a fixed size.
    files = [row.asDict() for row in sampling.written_manifest(raw.sparkSession, f"{folder}/samples").collect()]
    document["metadata"] = metadata(t.prepared.count(), files, source) | {"initial_columns": raw.columns}
    return document


def metadata(total: int, files: list[dict], source: str) -> dict:
    """Totals of the run and of the sample files, each with its place below the report's folder."""
    per_type = {kind: [f for f in files if f["type"] == kind] for kind in ("random", "balanced")}
    now = datetime.now(timezone.utc).isoformat()
    files = [
        f | {
            "path": f"samples/type={f['type']}/chunk_index={f['chunk_index']}", "total_chunks": len(per_type[f["type"]]),
            "chunk_size": sampling.CHUNK_ROWS, "date_processed": now,
        }
        for f in files
    ]
    return {
        "total_buildings": total,
        "id_field": "build_id",
        "class_codes": {code: name for name, code, _ in votes.CANDIDATES},
        "date_processed": now,
        "source_file": source,
        "version": VERSION,
        "samples_split": True,
        "samples_files": sorted(files, key=lambda f: (f["type"], f["chunk_index"])),
        **{f"total_{kind}_samples": sum(f["sample_count"] for f in found) for kind, found in per_type.items()},
        **{f"{kind}_chunks": len(found) for kind, found in per_type.items()},
    }


def as_json(document: dict) -> str:
    return json.dumps(document, indent=2, allow_nan=False)
