"""The corpus pipeline: each stage against its operator, kept columns, and odd rows."""

import corpus_pipeline
from odd import ODD_ROWS
from parapet.llm import line_dedup, near_dup
from parapet.staging import stage


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, function in corpus_pipeline.STAGES:
        before, docs = docs, stage(function(spark, docs, data), name)
        seen[name] = docs
        if name == "lines":
            want = {r.doc_id: r.text for r in line_dedup.dedup_lines(before).collect() if r.text or not r.n_dropped}
            assert {r.doc_id: r.text for r in docs.collect()} == want and all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "near_copies":
            kept = {r.doc_id for r in near_dup.near_duplicates(before, words=corpus_pipeline.COPY_WORDS).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        if name != "packing":
            assert docs.columns == columns
    last = seen["packing"]
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in seen["mixing"].collect()}
    assert corpus_pipeline.run(spark, data).count() == last.count()


def test_odd_rows(spark, documents, tmp_path):
    for rows, name in ((ODD_ROWS, "odd"), ([], "none")):
        documents([*rows]).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in out} <= {None, 4, 5, 6, 7, 8} and bool(out) == bool(rows)
