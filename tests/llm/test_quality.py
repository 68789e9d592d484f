import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kairoscope.llm import quality_classifier, quality_rules


def counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for n, window in enumerate(windows):
        if often[window] > 1:
            covered |= {n, n + 1, n + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(docs):
    rng = random.Random(6)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x x x", "é é é é\n\né é é é\n| $ <|>", "w " * 3000]
    texts += ["".join(rng.choices(["a ", "b ", "c\n", " ", "\t", "#x ", "日 "], k=rng.randint(0, 200))) for _ in range(80)]
    rows = list(enumerate(texts))
    measured = quality_rules.measure(docs(rows, n_words=5, lang="en"))
    for r in measured.filter("n_words >= 0").collect():  # the filter must not change the plan's meaning
        want = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_binomial_tail(spark):
    cases = [(0, 10, 0.01), (3, 500, 0.02), (15, 2000, 0.01), (0, 5000, 0.01), (400, 50_000, 0.01), (9, 900, 0.01), (10, 10, 0.5)]
    for k, n, p in cases:
        got = spark.range(1).select(quality_rules.ln_binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first().x
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(k + 1)]
        want = 0.0 if k >= n * p else math.log(math.fsum(math.exp(x - max(logs)) for x in logs)) + max(logs)
        assert got == pytest.approx(want, abs=1e-6), (k, n, p)


def test_cutoffs_keep_good_documents(spark):
    rng = random.Random(8)
    rows = [(n, "en" if n % 2 else None, rng.random() * 0.04 if n % 5 else 0.35, int(n % 5 > 0)) for n in range(6000)]
    table = spark.createDataFrame(rows, "doc_id long, lang string, symbol_rate double, quality int")
    measured = table.select("doc_id", "lang", F.lit(False).alias("base_failed"), "symbol_rate", *[F.lit(0.0).alias(c) for c in quality_rules.RATES[1:]])
    labels = table.select("doc_id", "quality")
    broken = labels.limit(1).withColumn("quality", 1 - F.col("quality")).unionByName(spark.createDataFrame([(None, 1), (9, None)], "doc_id long, quality int"))
    cutoffs = quality_rules.certify(measured, labels.unionByName(broken))
    assert {r.named for r in cutoffs.collect()} == {"en", None}
    assert all(r.symbol_rate == 0.3 and r.repeat_word_rate is None for r in cutoffs.collect())
    judged = quality_rules.judge(measured, cutoffs).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    assert {r.quality: r.kept for r in judged.collect()} == {0: 0.0, 1: 1.0}
    few = quality_rules.certify(measured, labels.filter("doc_id < 50"))
    assert all(r.symbol_rate is None for r in few.collect())
    none = quality_rules.judge(measured, quality_rules.certify(measured, labels.limit(0)))
    assert none.filter("kept").count() == 6000


@pytest.mark.parametrize("most", [0, 100_000])
def test_many_strata(spark, monkeypatch, most):
    """Every stratum has its own bound, however many there are; few labels or none leave the base rules."""
    monkeypatch.setattr(quality_rules, "BROADCAST_STRATA", most)
    rows = [(n, "main" if n % 3 else f"l{n}", 0.35 if n % 5 == 0 else 0.0, int(n % 5 > 0)) for n in range(9000)]
    table = spark.createDataFrame(rows, "doc_id long, lang string, symbol_rate double, quality int")
    measured = table.select("doc_id", "lang", F.lit(False).alias("base_failed"), "symbol_rate", *[F.lit(0.0).alias(c) for c in quality_rules.RATES[1:]])
    measured = measured.withColumns({"_own": F.lit(1), "_cut_symbol_rate": F.lit(2.0), "kept": F.lit("clash")})
    labels = table.filter("lang = 'main' or doc_id < 6000").select("doc_id", "quality")
    cutoffs = quality_rules.certify(measured, labels)
    assert {r.named: r.symbol_rate for r in cutoffs.collect() if r.symbol_rate is not None} == {"main": 0.3}
    assert cutoffs.count() == 2001
    judged = quality_rules.judge(measured, cutoffs)
    assert judged.columns == measured.columns
    dropped = {r.doc_id for r in judged.filter("not kept").collect()}
    assert dropped == {n for n, lang, rate, _ in rows if lang == "main" and rate}


def test_classifier_separates_held_out(spark):
    rng = random.Random(1)
    good = ["river", "mountain", "history", "music", "garden", "science", "ocean", "letter"]
    bad = ["BUY!!", "NOW$$", "WIN%%", "CASH**", "CLICK!!"]
    rows = []
    for n in range(600):
        label = n % 3 > 0
        rows.append((n, " ".join(rng.choices(good if label else bad, k=rng.randint(30, 200))), int(label)))
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int").withColumn("score", F.lit("clash"))
    docs = table.drop("quality").unionByName(spark.createDataFrame([(None, "", ""), (900, None, "")], "doc_id long, text string, score string"))
    labels = table.select("doc_id", "quality").unionByName(spark.createDataFrame([(None, 1), (3, None), (77777, 0)], "doc_id long, quality int"))
    model = quality_classifier.fit(docs, labels.filter(quality_classifier.remainder() != 2))
    scored = quality_classifier.score(docs, model)
    assert scored.filter("score is null or score < 0 or score > 1").count() == 0 and scored.count() == 602
    held = scored.filter(quality_classifier.remainder() == 2).join(table.select("doc_id", "quality"), "doc_id").collect()
    assert len(held) > 100 and sum(r.predicted == r.quality for r in held) / len(held) > 0.97


def test_classifier_without_labels(docs):
    table = docs([(1, "x"), (2, None)])
    labels = table.sparkSession.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality_classifier.fit(table, labels) is None
    assert [r.score for r in quality_classifier.score(table, None).collect()] == [1.0, 1.0]
    empty = docs([])
    assert quality_classifier.score(empty, None).collect() == []
