"""Non-finite numbers, missing-value words, typed pass-through columns, large sections."""

import json

import pytest
from parapet.operators import cleaning
from parapet.operators.quantiles import exact_quantiles
from parapet.plans import clf, report
from parapet.sources import readers, writers
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
MISSING_WORDS = ("NA", "N/A", "n/a", "NULL", "null", "NaN", "nan", "None", "<NA>", "")


def test_quantiles_leave_out_non_finite(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 1001)] + [(NAN,), (INF,), (-INF,), (None,)], "v double")
    assert exact_quantiles(df, "v", [0.5, 1.0]).table[None] == {0.5: 500.5, 1.0: 1000.0}
    assert exact_quantiles(df.where("v > 1000 OR isnan(v)"), "v", [0.5]).value(0.5) is None


def test_cleaning_drops_non_finite(spark):
    rows = [(i, 1950.0, 100.0, "3", 4.0) for i in range(5)] + [(5, NAN, 100.0, "3", 4.0), (6, 1950.0, NAN, "3", 4.0), (7, INF, 1.0, "3", 4.0), (8, 1950.0, 1.0, "x", INF)]
    df = spark.createDataFrame(rows, "build_id long, year_built double, gfa double, height string, pred_height double")
    assert sorted(r.build_id for r in cleaning.clean(df).collect()) == [0, 1, 2, 3, 4]
    funnel = cleaning.cleaning_funnel(df).first()
    assert (funnel.initial_count, funnel.year_missing, funnel.after_year_filter, funnel.after_missing_area, funnel.final_count) == (9, 2, 7, 6, 5)
    assert funnel.area_outlier_threshold == pytest.approx(100.0)


def test_missing_words_and_line_breaks(spark, tmp_path):
    lines = [f'{i},1950,"{w}",{w},"two\nlines"' for i, w in enumerate(MISSING_WORDS)]
    (tmp_path / "b.csv").write_text("BUILD_ID,year_built,OCC_CLS,material_type,note\n" + "\n".join([*lines, '99,1950,"Natural",None such,x']) + "\n")
    rows = {r.build_id: r for r in readers.read_buildings(spark, str(tmp_path / "b.csv")).collect()}
    assert len(rows) == len(MISSING_WORDS) + 1 and all(rows[str(i)].occ_cls is None and rows[str(i)].material_type is None for i in range(len(MISSING_WORDS)))
    assert rows["0"].note == "two\nlines" and (rows["99"].occ_cls, rows["99"].material_type) == ("Natural", "None such")


def test_shoreline_keeps_numbers(spark, tmp_path):
    (tmp_path / "s.csv").write_text("LATITUDE,SQMETERS,Est GFA sqmeters,note,code,year_built\n41.5,50,100.5,7a,NA,1950\nnan,60,inf,8,,-inf\n")
    df = readers.read_shoreline(spark, str(tmp_path / "s.csv"))
    kinds = dict(df.dtypes)
    assert (kinds["SQMETERS"], kinds["Est GFA sqmeters"], kinds["note"], kinds["LATITUDE"]) == ("bigint", "double", "string", "double")
    rows = sorted(map(lambda r: r.asDict(), df.collect()), key=lambda r: r["SQMETERS"])
    assert rows[1]["Est GFA sqmeters"] == INF and rows[1]["year_built"] == -INF and rows[1]["LATITUDE"] is None
    record = json.loads(df.where("SQMETERS = 50").select(writers.as_records(df)).first()[0])
    assert record["SQMETERS"] == 50 and record["Est GFA sqmeters"] == 100.5 and record["note"] == "7a" and record["code"] is None


def test_parquet_buildings(spark, tmp_path):
    spark.createDataFrame([("a1", 1950.0, NAN), ("a2", INF, 3.0)], "`OBJECTID` string, year_built double, `Est GFA sqmeters` double").write.parquet(str(tmp_path / "p"))
    rows = {r.build_id: r for r in readers.read_parquet(spark, str(tmp_path / "p")).collect()}
    assert rows["a1"].gfa is None and rows["a2"].year_built is None and rows["a2"].gfa == 3.0


def test_large_sections_stay_data_sets(spark, monkeypatch, data):
    monkeypatch.setattr(report, "SUMMARY_ROWS", 5)
    monkeypatch.setattr(clf, "SCATTER_ROWS", 5)
    df = spark.range(20).withColumn("x", F.lit(1.5))
    assert report._rows(df, "out/sections/x") == {"path": "out/sections/x"} and len(report._rows(df.limit(4), "p")) == 4
    from catalog.registry import Inputs
    found = clf.document(Inputs(spark, data).clf)
    assert found["scatter_data"] == {"path": "scatter"} and found["heatmap_struct_gfa"]["z"]
