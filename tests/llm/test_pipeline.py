"""The pipeline on a small table against a plain reimplementation of its decisions."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kairoscope.llm import quality_classifier


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ri", "mo", "ta", "len", "gar") for b in ("ver", "tan", "sic", "den", "ou")]
    good = lambda k: " ".join(rng.choices(words, k=k)) + "."
    rows, labels = [], []
    for n in range(300):
        bad = n % 6 == 0
        text = " ".join(f"{w}!!$$" for w in rng.choices(words, k=80)).upper() if bad else good(rng.randint(70, 150))
        rows.append((n, text, "en", "s", len(text)))
        labels.append((n, int(not bad), 0))
    rows.append((400, rows[1][1], "en", "s", 0))  # an exact copy
    rows.append((400, rows[1][1], "en", "s", 0))  # and the same row again
    rows.append((401, rows[2][1].replace(".", " end."), "en", "s", 0))  # a near copy
    rows.append((402, None, None, None, None))
    rows.append((None, good(90), "en", None, None))
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, path)
        assert out.columns == columns
        docs = docs.sparkSession.createDataFrame(out.collect(), out.schema)
        docs.write.mode("overwrite").parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        seen[name] = [r.doc_id for r in docs.collect()]
    clean = {n for n in range(300) if n % 6}
    model = seen["quality classifier"]
    assert clean <= set(model) and not {n for n in range(0, 300, 6)} & set(model)
    assert 402 not in seen["quality rules"]  # no words: the base rules
    assert clean <= set(seen["quality rules"]) and None in seen["quality rules"]
    exact = seen["exact dedup"]
    assert len(exact) == len(set(exact)) and len({1, 400} & set(exact)) == 1 and clean - {1} <= set(exact)
    near = seen["minhash near-dedup"]
    assert len({2, 401} & set(near)) == 1 and clean - {1, 2} <= set(near) and None in near


def test_run(spark, folder):
    path, _ = folder
    pieces = corpus_pipeline.run(spark, path)
    per_doc = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert per_doc.filter("n != m").isEmpty() and per_doc.count() > 240
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty()


def test_order_and_methods():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "exact dedup", "minhash near-dedup", "packing"]
    assert quality_classifier.THRESHOLD == 0.7


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
