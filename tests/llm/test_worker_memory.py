"""What the pipeline's stages keep in Python workers, which outlive their tasks."""

import random
import subprocess
import sys

import pyarrow as pa
from pyspark.sql import functions as F

from kairoscope.llm import exact_dedup, quality_classifier
from kairoscope.llm.bpe import RankCodec


def test_fit_starts_no_python_workers(spark, monkeypatch):
    rng = random.Random(5)
    texts = [(n, " ".join(rng.choices(["riv", "mol", "tas"] if n % 2 else ["!!", "##", "%%"], k=60))) for n in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").localCheckpoint()
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).localCheckpoint()
    # Local rows that are no Arrow table are pickled, spread and passed through Python workers.
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **b: 1 / 0)
    model = quality_classifier.fit(docs, labels)
    assert model is not None and len(model.weights) == 4


def test_combining_sends_on_early():
    text = "x" * 100_000

    def batches():
        for n in range(600):  # 60 MB of distinct content
            names = ["h", "content", "key", "group_size"]
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([f"{n} {text}"]), pa.array([n]), pa.array([1])], names)
            read[0] += 1

    read, sent, most = [0], 0, 0
    for batch in exact_dedup._combine(batches()):
        most = max(most, read[0] - sent)
        sent += len(batch)
        assert batch.nbytes < 4 << 20
    assert sent == 600
    assert most < 200  # at most 20 MB are held


def test_rank_codec_keeps_no_merges(vocabulary):
    codec = RankCodec(vocabulary)
    assert not codec.vocabulary.rank and not codec.vocabulary.made and not codec.vocabulary.merge_rank
    assert codec.vocabulary.bytes_of and len(codec.encode("Tidy words.")) > 0


def test_worker_gives_memory_back():
    code = """
import re
from kairoscope.llm.workers import tidy

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def run(batches):
    # Blocks below the size that the allocator maps by itself, and one after them that stays.
    parts = [bytes(50_000 + n % 7) for n in range(2_000)]
    global rest
    rest = bytes(40_000)
    yield from batches

before = held()
for _ in WRAP(run)(iter([None])):
    pass
print(held() - before)
"""
    grown = [float(subprocess.run([sys.executable, "-c", code.replace("WRAP", w)], stdout=subprocess.PIPE, text=True, check=True).stdout) for w in ("(lambda f: f)", "tidy")]
    assert grown[1] < 10 < grown[0]
