import json
import math
import os
from pathlib import Path

import pytest

from parapet.plans import buildings as plan
from parapet.plans import clf as clf_plan
from parapet.plans import report, shoreline
from parapet.sources import readers, standin, writers

#: The cluster sections take minutes.
CLUSTERS = bool(os.environ.get("PARAPET_ALL"))
# The sixteen published scatter rows (area, material, structural system).
SCATTER = [
    (2950.0, "S", "Steel"), (38750.0, "S", "Steel"), (18800.0, "S", "Steel"), (7950.0, "S", "Steel"), (590.0, "S", "Steel"),
    (47750.0, "S", "Steel"), (33000.0, "S", "Steel"), (5100.0, "W", "Wood: Mass Timber"), (3350.0, "S", "Steel"),
    (54500.0, "S", "Steel/Concrete"), (25500.0, "S", "Steel"), (16200.0, "S", "Steel"), (57000.0, "S", "Steel"),
    (30750.0, "S", "Steel/Concrete"), (26750.0, "S", "Steel"), (84500.0, "S", "Steel/Concrete"),
]


def test_published_heatmap_rows(spark):
    rows = [(g, 1.0, 1.0, "Commercial", m, s, "Deep" if i % 3 else "Shallow") for i, (g, m, s) in enumerate(SCATTER)]
    frame = spark.createDataFrame(rows, "gfa double, mass_total double, gwp_a_to_c double, occ_cls string, material_type string, str_sys_summary string, general_fnd_type string")
    doc = clf_plan.document(frame)
    sums = lambda name: dict(zip(doc[name]["y"], (sum(r) for r in doc[name]["z"])))
    assert sums("heatmap_material_gfa") == {"S": 448340.0, "W": 5100.0}
    assert sums("heatmap_material_count") == {"S": 15, "W": 1}
    assert sums("heatmap_struct_gfa") == {"Steel": 278590.0, "Steel/Concrete": 169750.0, "Wood: Mass Timber": 5100.0}
    assert sums("heatmap_struct_count") == {"Steel": 12, "Steel/Concrete": 3, "Wood: Mass Timber": 1}
    assert len(doc["scatter_data"]["gfa"]) == 16


def test_buildings_from_csv(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("OBJECTID,year_built,Est GFA sqmeters,HEIGHT,PRED_HEIGHT,OCC_CLS,OCC_DICT,note\n"
                    "1,1950,100.5,n/a,7,Unclassified,\"RES: 2, COM: 1\",x\n2,0,5,3,,Commercial,,y\n3,1980.0,nan,3,,,,z\n")
    raw = readers.read_buildings(spark, str(path))
    rows = plan.prepared(raw).collect()
    assert [(r.build_id, r.gfa, r.height_used, r.occ_cls, r.note, r.material_type) for r in rows] == [("1", 100.5, 7.0, "Residential", "x", None)]
    profile = readers.table_profile(raw).collect()
    assert profile[0].n_rows == 3 and "note" in {r.column_name for r in profile}


def test_missing_clf_file_is_skipped(spark, tmp_path):
    assert clf_plan.run(spark, str(tmp_path / "none.csv"), str(tmp_path / "out")) is None


def test_shoreline_records_spell_out_nulls(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("LATITUDE,LONGITUDE,OCC_CLS,year_built,extra\n42.1,-71.0,Residential,nan,a\n42.2,,,1900,\n")
    shoreline.run(spark, str(path), str(tmp_path / "out"))
    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert len(lines) == 2 and all({"material_type", "foundation_type", "extra"} <= set(x) for x in lines)
    first = next(x for x in lines if x["extra"] == "a")
    assert first["year_built"] is None and first["LATITUDE"] == 42.1


def test_written_records_have_no_nan(spark, tmp_path):
    df = spark.createDataFrame([(math.nan,), (math.inf,), (1.0,)], "v double")
    writers.write_records(df, str(tmp_path / "r"))
    text = "".join(f.read_text() for f in (tmp_path / "r").glob("part-*"))
    assert sorted(json.loads(x)["v"] is None for x in text.splitlines()) == [False, True, True]


@pytest.fixture(scope="module")
def document(spark, data, tmp_path_factory):
    folder = tmp_path_factory.mktemp("report")
    return folder, report.write_report(standin.buildings(spark, data), str(folder), "standin", clusters=CLUSTERS)


def test_report_document(document):
    folder, doc = document
    assert set(report.REPORTS) | (set(report.CLUSTER_REPORTS) if CLUSTERS else set()) | {"metadata"} == set(doc)
    meta = doc["metadata"]
    assert meta["total_buildings"] == 1309 == doc["summary_stats"][0]["total_buildings"]
    assert sum(r["n"] for r in doc["overview_occupancy_counts"]) <= 1309
    assert meta["random_chunks"] == 1 and meta["total_random_samples"] == meta["samples_files"][-1]["sample_count"]
    json.loads(report.as_json(doc))
    assert doc["cleaning_funnel"][0]["final_count"] == 1309


def test_report_files(document):
    folder, doc = document
    chunk = Path(folder) / "samples" / "type=random" / "chunk_index=1"
    files = list(chunk.glob("part-*"))
    assert len(files) == 1
    rows = [json.loads(x) for x in files[0].read_text().splitlines()]
    assert [r["sample_index"] for r in rows] == list(range(doc["metadata"]["total_random_samples"]))
    assert list((Path(folder) / "reclass_map").glob("part-*")) and list((Path(folder) / "map_points").glob("part-*"))


def test_links_resolve_to_names(document):
    _, doc = document
    for section, diagram in (("occupancy_hierarchy", "diagram"), ("occ_cls_vote_flow", "metric")):
        names = {(n[diagram], n["idx"]): n["name"] for n in doc[f"{section}_nodes"]}
        assert doc[section] and len(names) == len(doc[f"{section}_nodes"])
        for link in doc[section]:
            assert names[link[diagram], link["source_idx"]] != names[link[diagram], link["target_idx"]]
    assert [c["stage"] for c in doc["quality_checks"]] == ["raw", "cleaned"] and "gfa" in doc["metadata"]["initial_columns"]


def test_sample_files_lie_where_the_document_says(document):
    folder, doc = document
    for f in doc["metadata"]["samples_files"]:
        assert list((Path(folder) / f["path"]).glob("part-*")) and f["total_chunks"] >= f["chunk_index"]
    assert doc["metadata"]["class_codes"]["R"] == "Residential"
