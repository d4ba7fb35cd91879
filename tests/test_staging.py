from pathlib import Path
from types import SimpleNamespace

import pytest

from parapet.staging import cleared, shared_folder, stage


def _session(master, configured):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: configured), sparkContext=SimpleNamespace(master=master))


def test_configured_folder_wins():
    assert shared_folder(_session("yarn", "hdfs:///shared/")) == "hdfs:///shared"


def test_temporary_folder_only_for_a_local_master():
    assert shared_folder(_session("local[2]", None)) == shared_folder(_session("local[2]", None))
    with pytest.raises(ValueError):
        shared_folder(_session("spark://host:7077", None))


def test_staged_table_is_the_same_table(spark):
    df = spark.range(1000).selectExpr("id AS build_id", "CAST(id % 7 AS STRING) AS label")
    written = stage(df, "numbers", spread_by="build_id")
    assert written.schema.names == df.schema.names and written.count() == 1000
    assert written.exceptAll(df).count() == 0


def test_tables_of_a_block_are_deleted_with_it(spark):
    kept = stage(spark.range(5), "kept")
    with cleared(spark):
        inside = stage(spark.range(7), "inside")
        folder = Path(inside.inputFiles()[0].removeprefix("file://")).parent
        assert inside.count() == 7 and folder.exists()
    assert not folder.exists() and kept.count() == 5


def test_files_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr("parapet.staging.FILE_ROWS", 10)
    df = spark.range(200).selectExpr("id AS build_id")
    assert len(stage(df, "grown", spread_by="build_id", rows=200).inputFiles()) > 10
