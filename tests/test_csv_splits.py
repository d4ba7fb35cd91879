"""CSV files without quoted line breaks are read by many tasks, others whole, with the same rows."""

import pytest
from parapet.sources import readers

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get(SPLIT)
    spark.conf.set(SPLIT, "32k")
    yield
    spark.conf.set(SPLIT, before)


def _file(path, n, note, first=0):
    lines = ["BUILD_ID,year_built,OCC_CLS,note"] + [f'{i},19{i % 100:02d},"Class ""{i % 3}"", or so",{note}' for i in range(first, first + n)]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


def _rows(df):
    return sorted((int(r.build_id), r.year_built, r.occ_cls, r.note) for r in df.collect())


def _want(n, note, first=0):
    return [(i, 1900.0 + i % 100, f'Class "{i % 3}", or so', note) for i in range(first, first + n)]


def test_plain_file_is_split(spark, tmp_path, small_splits):
    _file(tmp_path / "plain.csv", 6000, '"ünï, ""q"""')
    df = readers.read_buildings(spark, str(tmp_path / "plain.csv"))
    assert df.rdd.getNumPartitions() > 4
    assert _rows(df) == _want(6000, 'ünï, "q"')


def test_file_with_breaks_is_read_whole(spark, tmp_path, small_splits):
    _file(tmp_path / "broken.csv", 6000, '"two\nlines, ""q"""')
    df = readers.read_buildings(spark, str(tmp_path / "broken.csv"))
    assert df.rdd.getNumPartitions() == 1
    assert _rows(df) == _want(6000, 'two\nlines, "q"')


def test_folder_of_both_kinds(spark, tmp_path, small_splits):
    folder = tmp_path / "a folder"
    folder.mkdir()
    _file(folder / "1 plain.csv", 5000, "x")
    _file(folder / "2 broken.csv", 700, '"a\r\nb"', 5000)
    _file(folder / "3 plain.csv", 300, "y", 5700)
    df = readers.read_buildings(spark, str(folder))
    assert df.rdd.getNumPartitions() > 4
    got = _rows(df)
    assert [r[:3] for r in got] == [r[:3] for r in _want(6000, None)]
    assert {r[3].replace("\r\n", "\n") for r in got if 5000 <= r[0] < 5700} == {"a\nb"} and {r[3] for r in got if r[0] >= 5700} == {"y"}


def test_stray_quote_is_read_as_before(spark, tmp_path):
    """An odd quote outside of quoted fields costs the split, not the rows."""
    (tmp_path / "s.csv").write_text('BUILD_ID,note\n1,5" pipe\n2,x\n3,\n')
    assert [(r.build_id, r.note) for r in readers.read_buildings(spark, str(tmp_path / "s.csv")).orderBy("build_id").collect()] == [("1", '5" pipe'), ("2", "x"), ("3", None)]


def test_empty_and_header_only(spark, tmp_path):
    (tmp_path / "h.csv").write_text("BUILD_ID,note\n")
    assert readers.read_buildings(spark, str(tmp_path / "h.csv")).count() == 0
    assert readers.read_clf(spark, str(tmp_path / "none.csv")) is None
