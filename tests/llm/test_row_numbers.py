"""Rows dropped by the pipeline are those judged, however a later scan is split."""

import pytest

import corpus_pipeline
from kairoscope.staging import stage

STEPS = [("drop_copies", corpus_pipeline.exact_dedup, "exact_dedup"), ("drop_near_copies", corpus_pipeline.minhash, "near_classes")]


@pytest.mark.parametrize("step, module, judge", STEPS)
def test_scan_split_otherwise(spark, tmp_path, monkeypatch, step, module, judge):
    """The splits change after the rows were judged, as when executors come or go."""
    texts = [f"text {n} with its own words a{n} b{n} c{n} d{n} e{n}" for n in range(40)]
    for n in range(4):
        rows = [(10 * n + i, texts[10 * n + i]) for i in range(10)] + [(100 + n, texts[5])]
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    whole = getattr(module, judge)

    def judged(*args, **named):
        found = stage(whole(*args, **named), "found")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        return found

    monkeypatch.setattr(module, judge, judged)
    spark.conf.set("spark.sql.files.minPartitionNum", "4")
    try:
        left = [r.text for r in getattr(corpus_pipeline, step)(spark, docs, "").collect()]
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted(left) == sorted(texts)
