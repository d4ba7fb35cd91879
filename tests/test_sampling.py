import hashlib
import math

import pytest
from pyspark.sql import functions as F

from parapet.operators import sampling
from parapet.sources.writers import write_chunks


def _key(i):
    return hashlib.md5(f"{i}#337".encode()).hexdigest()


def _people(spark, n, parts=3):
    # One class holds two thirds of all rows.
    return spark.range(n, numPartitions=parts).select(
        F.col("id").alias("build_id"), F.when(F.col("id") % 3 > 0, "big").when(F.col("id") % 6 == 0, "mid").otherwise(F.lit(None)).alias("occ_cls"))


@pytest.mark.parametrize("slack", [50_000, 1])
def test_random_sample_is_exact_and_independent_of_partitions(spark, monkeypatch, slack):
    monkeypatch.setattr(sampling, "SLACK_ROWS", slack)
    expected = set(sorted(range(3000), key=_key)[:700])
    for parts in (1, 7):
        got = [r.build_id for r in sampling.random_sample(_people(spark, 3000, parts), 700).collect()]
        assert len(got) == 700 and set(got) == expected
    assert sampling.random_sample(_people(spark, 50), 700).count() == 50


@pytest.mark.parametrize("slack", [50_000, 1])
def test_stratified_sample(spark, monkeypatch, slack):
    monkeypatch.setattr(sampling, "SLACK_ROWS", slack)
    rows = sampling.stratified_sample(_people(spark, 3000), rows=600).collect()
    got = {c: {r.build_id for r in rows if r.occ_cls == c} for c in ("big", "mid")}
    assert got["big"] == set(sorted((i for i in range(3000) if i % 3), key=_key)[:600])
    assert got["mid"] == {i for i in range(3000) if i % 6 == 0}
    assert all(r.occ_cls for r in rows)


@pytest.mark.parametrize("n, chunks", [(0, 0), (1, 1), (5000, 1), (5001, 2)])
def test_chunks(spark, n, chunks):
    rows = sampling.chunked(spark.range(n).withColumnRenamed("id", "build_id")).collect()
    assert sorted(r.sample_index for r in rows) == list(range(n))
    assert len({r.chunk_index for r in rows}) == chunks
    assert [r.build_id for r in sorted(rows, key=lambda r: r.sample_index)] == sorted(range(n), key=_key)


def test_manifest_warns_about_large_chunks(spark):
    rows = [("random", 1, i, "x" * 1000) for i in range(100)] + [("random", 2, 0, "x")]
    chunks = spark.createDataFrame(rows, "type string, chunk_index bigint, sample_index int, text string")
    got = {r.chunk_index: r for r in sampling.chunk_manifest(chunks, limit_mb=0.05, size=100).collect()}
    assert got[1].too_large and got[1].sample_count == 100 and got[1].suggested_chunk_rows > 0
    assert not got[2].too_large and got[2].filename == "building_data_samples_random_2.json"


def test_manifest_sizes_are_those_of_the_files(spark, tmp_path):
    rows = [("random", i // 5000 + 1, i, float("nan") if i % 7 == 0 else i / 3, None if i % 2 else "ä") for i in range(6000)]
    chunks = spark.createDataFrame(rows, "type string, chunk_index bigint, sample_index int, area double, label string")
    write_chunks(chunks, str(tmp_path / "samples"))
    for row in sampling.chunk_manifest(chunks, limit_mb=0.1, size=5000).collect():
        files = list((tmp_path / "samples" / "type=random" / f"chunk_index={row.chunk_index}").glob("part-*"))
        assert len(files) == 1 and files[0].stat().st_size == row.size_bytes
        assert row.size_mb == round(row.size_bytes / 1024 / 1024, 2)
        assert (row.suggested_chunk_rows is not None) == row.too_large == (row.chunk_index == 1)
        if row.too_large:
            assert row.suggested_chunk_rows == math.floor(5000 * 20 / (row.size_bytes / 1024 / 1024))
    told = sorted(map(tuple, sampling.chunk_manifest(chunks, limit_mb=0.1, size=5000).collect()))
    assert sorted(map(tuple, sampling.written_manifest(spark, str(tmp_path / "samples"), limit_mb=0.1, size=5000).collect())) == told


def test_manifest_of_no_chunks(spark, tmp_path):
    chunks = spark.createDataFrame([], "type string, chunk_index bigint, sample_index int")
    write_chunks(chunks, str(tmp_path / "samples"))
    found = sampling.written_manifest(spark, str(tmp_path / "samples"))
    assert found.collect() == [] and found.columns == sampling.chunk_manifest(chunks).columns


def test_manifest_tells_what_is_there(spark, tmp_path):
    """A chunk of two files, as after a write by several tasks, and a row with a line break in its text."""
    rows = [("random", 1, i, "a\nb" if i else "x") for i in range(4)]
    chunks = spark.createDataFrame(rows, "type string, chunk_index bigint, sample_index int, label string")
    chunks.repartition(2, "sample_index").write.partitionBy("type", "chunk_index").json(str(tmp_path / "samples"))
    row = sampling.written_manifest(spark, str(tmp_path / "samples")).first()
    files = list((tmp_path / "samples" / "type=random" / "chunk_index=1").glob("part-*"))
    assert row.sample_count == 4 and row.size_bytes == sum(f.stat().st_size for f in files)
