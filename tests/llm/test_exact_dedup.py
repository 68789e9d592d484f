import hashlib
import random
import re

from pyspark.sql import functions as F

from kairoscope.llm import exact_dedup as module
from kairoscope.llm.exact_dedup import OpenTable, exact_dedup, leaf_buckets


def brute(rows):
    groups = {}
    for key, text in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        groups.setdefault(norm, []).append(key)
    return {n: (min(k), len(k), hashlib.sha256(n.encode()).hexdigest()) for n, k in groups.items()}


def check(result, rows):
    want = brute(rows)
    got = {r.doc_id: r for r in result}
    for key, text in rows:
        keep, size, digest = want[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")]
        r = got[key]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, size, key == keep, digest)


def test_equals_brute_force(docs):
    rng = random.Random(4)
    texts = ["a b", "a  b", "a\tb\n", "a b ", "", None, " ", "é", "x" * 50_000] + ["hot copy"] * 10
    rows = [(n, rng.choice(texts)) for n in range(300)]
    result = exact_dedup(docs(rows, kept="clash", keep_id=3).repartition(5)).collect()
    assert len(result) == 300
    check(result, rows)


def test_oversized_buckets_split(docs):
    rows = [(n, f"text number {n % 150} " + "z" * 200) for n in range(300)]
    check(exact_dedup(docs(rows).repartition(3), bucket_bytes=500).collect(), rows)


def test_leaves_fit(spark):
    sizes = spark.range(2000).select(F.xxhash64("id").bitwiseAND(F.lit((1 << 63) - 1)).alias("h"), F.lit(100).cast("long").alias("bytes"))
    leaf, _ = leaf_buckets(sizes, 1000)
    largest = sizes.groupBy(leaf.alias("leaf")).agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0]
    assert largest <= 1000


def test_colliding_hashes_are_told_apart():
    table = OpenTable(4)
    for n in range(200):
        table.add(7, f"text {n % 50}", n, 1)
    assert len(table.content) == 50 and set(table.count) == {4} and table.key == list(range(50))


def test_tasks_flush_early(docs, monkeypatch):
    monkeypatch.setattr(module, "TASK_BYTES", 10)
    rows = [(n, f"t{n % 3}") for n in range(60)]
    check(exact_dedup(docs(rows)).collect(), rows)


def test_nulls_and_repeats(docs):
    rows = [(5, "same"), (5, "same"), (None, "same"), (None, "only")]
    result = exact_dedup(docs(rows)).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in result) == [
        (-1, -1, 1, True), (-1, 5, 3, False), (5, 5, 3, False), (5, 5, 3, True),
    ]
    assert exact_dedup(docs([])).collect() == []
