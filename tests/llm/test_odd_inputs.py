"""Clashing helper names, repeated rows, long words, lost commits."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kairoscope.llm import bpe, exact_dedup, line_dedup, minhash, quality_classifier, quality_rules, token_rollup, url_filter

CHANGES = "action string, doc_id long, source string, lang string, tokenizer string, n_tokens long"
HELPERS = ["_key", "_digest", "_copy", "_body", "_words", "_n", "_url", "_row", "_ruled", "_rest", "_grams", "_fold", "_text", "hidden0"]


@pytest.fixture
def odd(docs):
    """A table whose extra columns have the names of helper columns."""
    return docs([(1, "one two three"), (2, None), (1, "one two three")], **{name: name for name in HELPERS})


def unchanged(result):
    return all(r[name] == name for r in result.collect() for name in HELPERS) and result.count() == 3


def test_helper_names_do_not_clash(odd, vocabulary):
    assert unchanged(exact_dedup.exact_dedup(odd))
    measured = quality_rules.measure(odd)
    assert unchanged(measured) and sorted(r.n_words for r in measured.collect()) == [0, 3, 3]
    assert unchanged(bpe.encode(odd, vocabulary))
    assert unchanged(token_rollup.count_tokens(odd, vocabulary))
    assert unchanged(quality_classifier.score(odd, None))
    assert unchanged(url_filter.judge(odd.withColumnRenamed("text", "url")))


def test_text_under_a_helper_name(docs, vocabulary):
    table = docs([(1, "a b"), (2, "a  b")]).withColumnsRenamed({"doc_id": "_key", "text": "_body"})
    found = exact_dedup.exact_dedup(table, key="_key", text="_body")
    assert sorted((r._key, r.keep_id, r.kept) for r in found.collect()) == [(1, 1, True), (2, 1, False)]
    assert [r.n_words for r in quality_rules.measure(table, text="_body").collect()] == [2, 2]


def test_repeated_rows_keep_one(docs):
    text = "a long line that is the same in both of the rows " * 3
    rows = docs([(1, text), (1, text), (2, text + "end"), (None, text), (3, ""), (3, "")])
    near = minhash.near_classes(rows).collect()
    assert sorted(r.doc_id for r in near if r.kept) == [1, 3, 3] and {r.class_key for r in near if r.doc_id != 3} == {1}
    lines = line_dedup.fuzzy_lines(docs([(1, text), (1, text), (2, "another thing")])).collect()
    assert sorted(r.doc_id for r in lines if r.kept) == [1, 2] and len(lines) == 3


def test_a_word_of_a_million_letters(vocabulary):
    word = "".join("abcdeghijklmnorstuvwz"[n * n % 21] for n in range(1_000_000))
    started = time.monotonic()
    codec = bpe.Codec(vocabulary)
    ids = codec.encode_batch([word])[0]
    assert time.monotonic() - started < 120
    assert codec.decode(ids) == word
    start = word[:20_000]
    want = Tokenizer.from_file(vocabulary).encode(start, add_special_tokens=False).ids
    assert memoryview(codec.encode_batch([start])[0]).cast("I").tolist() == want


def test_lost_writers_do_not_block(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    one = spark.createDataFrame([("insert", 1, "s", "en", "t", 5)], CHANGES)
    assert rollup.apply(one, "a")
    os.makedirs(tmp_path / "r" / "attempts", exist_ok=True)
    (tmp_path / "r" / "attempts" / "lost").write_text("{")  # lost before the rename
    done = rollup.commits()
    late = rollup._written(spark.createDataFrame([("insert", 2, "s", "en", "t", 1)], CHANGES), "late", done)
    assert rollup.apply(spark.createDataFrame([("insert", 3, "s", "en", "t", 2)], CHANGES), "b")
    assert rollup._commit(late) is False  # another writer took the place
    assert rollup.apply(spark.createDataFrame([("insert", 2, "s", "en", "t", 1)], CHANGES), "late")
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "t", 3, 8)]
    assert [json.loads((tmp_path / "r" / "commits" / n).read_text())["batch_id"] for n in sorted(os.listdir(tmp_path / "r" / "commits")) if n[0] != "."] == ["a", "b", "late"]


def test_snapshots(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_rollup, "COMPACT", 2)
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    for n in range(5):
        rows = [("insert", n, "s", "en", "t", 10), ("delete", n - 1, None, None, "t", None), ("revise", 0, "s", "en", "t", n)]
        assert rollup.apply(spark.createDataFrame(rows if n else rows[:1], CHANGES), f"b{n}")
    assert len(rollup.commits()) <= 3 and rollup.commits()[0].batch_id is None
    assert not rollup.apply(spark.createDataFrame([("insert", 9, "s", "en", "t", 1)], CHANGES), "b0")
    for table in (rollup.totals(), rollup.recount()):
        assert [tuple(r) for r in table.collect()] == [("s", "en", "t", 2, 14)]
