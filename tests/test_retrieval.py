"""Retrieval paths agree with brute force; ranking rules hold on small cases."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairoscope.functions.vectors import cosine, cosine_pairs, embed_text
from kairoscope.operators import ranking, retrieval, temporal
from kairoscope.schemas import STAMP_COLUMNS, RerankWeights
from kairoscope.sources.tables import scan_index, write_vectors

DIM, N, Q = 8, 400, 12


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(N, DIM)).astype(np.float32)
    v[50:170] = v[50]  # many equal frames: ties fall back to the id
    q = rng.normal(size=(Q, DIM))
    q[3] = v[50]
    frames = [(f"f{i:03d}", f"v{i % 3}", "video", float(i), v[i].tolist()) for i in range(N)]
    vectors = spark.createDataFrame(
        frames, "frame_id string, video_id string, media_type string, timestamp double, embedding array<float>"
    ).repartition(5)
    comps = [(f"q{i}", c, q[(i + c) % Q].tolist()) for i in range(Q) for c in range(1 + i % 3)]
    queries = spark.createDataFrame(comps, "query_id string, component int, embedding array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = unit(q) @ unit(v.astype(np.float64)).T
    return vectors, queries, cos


def brute(cos, k, method, boost):
    out = {}
    for i in range(Q):
        n = 1 + i % 3
        w = np.array([boost if n > 1 and c == 0 else 1.0 for c in range(n)])
        part = np.round((1 + cos[[(i + c) % Q for c in range(n)]]) / 2 * w[:, None], 12)
        score = np.round(part.max(0) if method == "max" else part.sum(0), 12)
        order = sorted(range(N), key=lambda f: (-score[f], f))[:k]
        out[f"q{i}"] = [(f"f{f:03d}", round(float(score[f]), 9), int(part[:, f].argmax())) for f in order]
    return out


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["frame_id"], round(r["score"], 9), r["matched_component"]))
    return out


@pytest.mark.parametrize("method", ["max", "sum"])
@pytest.mark.parametrize("rows", [10_000, 6])
@pytest.mark.parametrize("floors", [False, True])
def test_exact_paths(data, method, rows, floors, monkeypatch):
    """One batch of queries and, with a tiny bound, several; with and without floors."""
    if floors:
        monkeypatch.setattr(retrieval, "SAMPLE_FROM", 10)
        monkeypatch.setattr(retrieval, "SAMPLE_ROWS", 40)
    vectors, queries, cos = data
    got = ranked(retrieval.top_k(vectors, queries, 30, method=method, boost=1.3, broadcast_rows=rows))
    assert got == brute(cos, 30, method, 1.3)


def test_small_blocks(data, monkeypatch):
    vectors, queries, cos = data
    block = retrieval.QueryBlock(queries.toArrow(), 1.3)
    best = retrieval.LocalBest(block, 7, 0.0, "max")
    monkeypatch.setattr(retrieval, "PAIR_BUDGET", 60)
    for batch in vectors.toArrow().to_batches():
        best.add(batch)
    out = best.result().to_pydict()
    got = {}
    for q, f, s in zip(out["query_id"], out["frame_id"], out["score"]):
        got.setdefault(q, []).append((f, round(s, 9)))
    assert got == {q: [x[:2] for x in rows] for q, rows in brute(cos, 7, "max", 1.3).items()}


def test_min_similarity_tests_before_the_cut(data):
    vectors, queries, cos = data
    hits = retrieval.top_k(vectors, queries.filter("component = 0"), N, min_similarity=0.6).collect()
    assert len(hits) == int(((1 + cos) / 2 >= 0.6).sum())


def test_more_wanted_than_there_is(data):
    vectors, queries, _ = data
    assert retrieval.top_k(vectors.limit(4), queries, 50).count() == 4 * Q


def test_no_queries(data):
    vectors, queries, _ = data
    assert retrieval.top_k(vectors, queries.filter("query_id = 'none'"), 5).count() == 0


def test_dimension_mismatch_fails(spark, data):
    vectors, _, _ = data
    bad = spark.createDataFrame([("q", [1.0, 2.0])], "query_id string, embedding array<double>")
    with pytest.raises(Exception, match="dimension"):
        retrieval.top_k(vectors, bad, 5).collect()


def test_rows_leaving_the_scan_do_not_grow_with_the_tasks(spark, monkeypatch):
    """With floors about k frames a query leave the scan, in few tasks as in many."""
    monkeypatch.setattr(retrieval, "SAMPLE_FROM", 10)
    monkeypatch.setattr(retrieval, "SAMPLE_ROWS", 200)
    sent = []

    def counted(hits, k, parts):
        sent.append(hits.count())
        return rank(hits, k, parts)

    rank = retrieval._rank
    monkeypatch.setattr(retrieval, "_rank", counted)
    rng = np.random.default_rng(8)
    rows = [(f"f{i:04d}", "v", "video", float(i), rng.normal(size=DIM).tolist()) for i in range(6000)]
    vectors = spark.createDataFrame(rows, "frame_id string, video_id string, media_type string, timestamp double, embedding array<double>")
    queries = spark.createDataFrame([("q", rng.normal(size=DIM).tolist())], "query_id string, embedding array<double>")
    for tasks in (4, 16):
        retrieval.top_k(vectors.repartition(tasks), queries, 20)
    monkeypatch.setattr(retrieval, "SAMPLE_FROM", 10**9)
    retrieval.top_k(vectors.repartition(16), queries, 20)
    few, many, without = sent
    assert many <= 2 * few and many < 160 and without == 16 * 20


@pytest.mark.parametrize("rows", [10_000, 6])
@pytest.mark.parametrize("method", ["max", "sum"])
def test_approximate(data, rows, method):
    """All cells and frames tried = exact; few of both = most of it."""
    vectors, queries, _ = data
    book = retrieval.fit_codebook(vectors, 6, parts=4)
    index = retrieval.index_vectors(vectors, book)
    assert index.count() == N and index.filter("length(code) != 4").isEmpty()
    exact = ranked(retrieval.top_k(vectors, queries, 20, method=method))
    every = retrieval.approx_top_k(index, queries, book, 20, n_probe=6, method=method, rescore=N, broadcast_rows=rows)
    assert ranked(every) == exact
    some = ranked(retrieval.approx_top_k(index, queries.filter("component = 0"), book, 20, n_probe=4, rescore=4))
    exact = ranked(retrieval.top_k(vectors, queries.filter("component = 0"), 20))
    found = sum(len({f for f, *_ in some[q]} & {f for f, *_ in exact[q]}) for q in exact)
    assert found / (20 * Q) > 0.7


def test_unprobed_cells_are_not_read(data, spark, tmp_path):
    vectors, queries, _ = data
    book = retrieval.fit_codebook(vectors, 8)
    write_vectors(retrieval.index_vectors(vectors, book), str(tmp_path / "index"))
    index = scan_index(spark, str(tmp_path / "index"))
    one = queries.filter("query_id = 'q0' and component = 0")
    hits = retrieval.approx_top_k(index, one, book, 5, n_probe=1)
    assert hits.count() == 5
    plan = hits._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell_id", plan)
    shuffled = re.findall(r"Exchange hashpartitioning.*", plan.split("== Physical Plan ==")[1])
    assert shuffled and not any("embedding" in line for line in shuffled)


def test_cosine_forms_agree(data):
    vectors, queries, _ = data
    pair = vectors.limit(50).withColumn("b", F.reverse("embedding"))
    both = pair.select(cosine(F.col("embedding"), F.col("b")).alias("x"), cosine_pairs("embedding", "b").alias("y"))
    assert all(abs(r["x"] - r["y"]) < 1e-12 for r in both.collect())


def test_text_embedding(spark):
    df = spark.createDataFrame([("Red car", ), ("car, RED!",), ("",), ("élan 42",)], "t string")
    rows = [r["embedding"] for r in embed_text(df, "t", 16).collect()]
    assert rows[0] == rows[1] and rows[2] == [0.0] * 16
    assert all(abs(sum(x * x for x in rows[i]) - 1) < 1e-12 for i in (0, 3))


def test_expansion(spark):
    df = spark.createDataFrame([("a", "a dog near a red car"), ("b", "sandy beach"), ("c", "x and with y"), ("d", "  ")], "query_id string, query string")
    got = {}
    for r in ranking.expand_queries(ranking.guard_queries(df)).collect():
        got.setdefault(r["query_id"], []).append((r["component"], r["component_text"]))
    assert got["a"] == [(0, "a dog near a red car"), (1, "a dog"), (2, "a red car")]
    assert got["b"] == [(0, "sandy beach")]  # "and" inside a word does not split
    assert got["c"][0] == (0, "x and with y") and "d" not in got


def test_single_component_fusion_is_unchanged(spark):
    df = spark.createDataFrame(
        [("q", "f", 0, 1, 0.7), ("p", "f", 0, 2, 0.5), ("p", "f", 1, 2, 0.55)],
        "query_id string, frame_id string, component int, n_components int, similarity double",
    )
    for method, p in (("max", 0.6), ("sum", 1.15)):
        got = {r["query_id"]: r["score"] for r in ranking.fuse(df, method, 1.2).collect()}
        assert got == pytest.approx({"q": 0.7, "p": p})


HITS = "query_id string, video_id string, frame_id string, timestamp double, raw_similarity double, score double, matched_component int"


def test_grouping_edges(spark):
    hits = [("q", "v", "a", 0.0), ("q", "v", "b", 10.0), ("q", "v", "c", 20.5), ("q", "v", "d", 20.5), ("q", "w", "e", 3.0)]
    df = spark.createDataFrame([(*h, 0.1, s, 0) for h, s in zip(hits, (0.5, 0.6, 0.7, 0.7, 0.1))], HITS)
    events = temporal.group_events(df, 10.0)
    assert {r["frame_id"]: r["event_index"] for r in events.collect()} == {"a": 0, "b": 0, "c": 1, "d": 1, "e": 0}
    assert {r["frame_id"] for r in temporal.representatives(events).collect()} == {"b", "c", "e"}


def test_default_rerank_keeps_single_video_order(spark):
    rng = np.random.default_rng(1)
    raw = rng.uniform(-1, 1, 40)
    df = spark.createDataFrame([("q", "v", f"f{i:02d}", float(i), float(r), (1 + float(r)) / 2, 0) for i, r in enumerate(raw)], HITS)
    out = ranking.rerank(ranking.normalize(df)).orderBy("rank").collect()
    assert [r["frame_id"] for r in out] == [f"f{i:02d}" for i in np.argsort(-raw, kind="stable")]
    penal = ranking.rerank(ranking.normalize(df), RerankWeights(duplicate=1.0, duplicate_window_s=2.0)).orderBy("rank").first()
    assert penal["frame_id"] == f"f{int(np.argmax(raw)):02d}"


def test_normalisation(spark):
    df = spark.createDataFrame([("q", "v", "a", 0.0, 0.2, 0.6, 0), ("q", "v", "b", 1.0, 0.2, 0.6, 0)], HITS)
    assert [r["similarity"] for r in ranking.normalize(df, "minmax").collect()] == [1.0, 1.0]
    assert [r["similarity"] for r in ranking.normalize(df, "none").collect()] == [0.6, 0.6]
    with pytest.raises(ValueError):
        ranking.normalize(df, "other")


def test_fine_merge_cases(spark):
    coarse = spark.createDataFrame(
        [("q", "v", e, f"c{e}", 10.0 * e, 0.1, 0.5) for e in range(4)],
        "query_id string, video_id string, event_index int, frame_id string, timestamp double, raw_similarity double, score double",
    )
    fine = spark.createDataFrame(
        [("q", "v", 0, "lo", 1.0, 0.1, 0.4), ("q", "v", 1, "eq", 1.0, 0.1, 0.5), ("q", "v", 2, "hi", 21.0, 0.3, 0.9), ("q", "v", 2, "hi2", 20.5, 0.3, 0.9)],
        coarse.schema,
    )
    got = {r["event_index"]: (r["frame_id"], r["retrieval_stage"]) for r in ranking.merge_fine(coarse, fine).collect()}
    assert got == {0: ("c0", "coarse"), 1: ("c1", "coarse"), 2: ("hi2", "fine"), 3: ("c3", "coarse")}


def test_external_permutation(spark):
    hits = spark.createDataFrame([(q, f, r) for q in "abcd" for r, f in enumerate("xyz", 1)], "query_id string, frame_id string, rank int")
    good = [("a", "x", 3), ("a", "y", 1), ("a", "z", 2)]
    repeated = [("b", "x", 1), ("b", "y", 1), ("b", "z", 2)]
    foreign = [("c", "x", 1), ("c", "y", 2), ("c", "w", 3)]
    supplied = spark.createDataFrame(good + repeated + foreign, "query_id string, frame_id string, new_rank int")
    out = ranking.accept_permutation(hits, supplied).collect()
    assert {(r["query_id"], r["rerank"]) for r in out} == {("a", "applied"), ("b", "skipped"), ("c", "skipped"), ("d", "unavailable")}
    assert {r["frame_id"]: r["final_rank"] for r in out if r["query_id"] == "a"} == {"x": 3, "y": 1, "z": 2}
    assert all(r["final_rank"] == r["rank"] for r in out if r["query_id"] != "a")


def test_compatibility_gate(spark):
    stamps = {"dim": "4", "model": "m", "model_revision": "1", "preprocessing_version": "p", "indexing_version": "i"}
    df = spark.createDataFrame([("4", "m", "1", "p", "i"), ("4", "n", "1", "p", "i")], ", ".join(f"{c} string" for c in STAMP_COLUMNS))
    with pytest.raises(ValueError):
        ranking.require_compatible(df, stamps)
    assert ranking.require_compatible(df, stamps, allow_mismatch=True).count() == 1
    assert ranking.require_compatible(df.filter("model = 'm'"), stamps).count() == 1


def test_frames_near_is_closed(spark):
    m = spark.createDataFrame([("q", "m", "v", 10.0)], "query_id string, frame_id string, video_id string, timestamp double")
    f = spark.createDataFrame([(str(t), "v", float(t)) for t in (1.9, 2, 10, 18, 18.1)] + [("o", "w", 10.0)], "frame_id string, video_id string, timestamp double")
    assert {r["near_frame_id"] for r in temporal.frames_near(m, f, 8.0).collect()} == {"2", "10", "18"}
    best = temporal.nearest_frame(m, f, 8.0, ["query_id", "frame_id"]).first()
    assert best["near_frame_id"] == "10"


def test_frames_stay_where_they_are(spark, monkeypatch):
    """Few moments are broadcast; of many, their slots leave out frames before the join. Both find the same."""
    rng = np.random.default_rng(3)
    frames = spark.createDataFrame([(f"f{i}", f"v{rng.integers(4)}", float(rng.integers(4000))) for i in range(900)], "frame_id string, video_id string, timestamp double")
    moments = spark.createDataFrame([(f"m{i}", f"v{rng.integers(5)}", float(rng.integers(4000))) for i in range(60)], "frame_id string, video_id string, timestamp double")
    f, m = frames.toPandas(), moments.toPandas()
    both = m.merge(f, on="video_id", suffixes=("", "_near"))
    both = both[(both.timestamp - both.timestamp_near).abs() <= 8.0]
    want = sorted(zip(both.frame_id, both.frame_id_near))
    shown = lambda df: sorted((r.frame_id, r.near_frame_id) for r in df.collect())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = temporal.frames_near(moments, frames, 8.0)
        assert near.columns == ["frame_id", "video_id", "timestamp", "near_frame_id", "near_video_id", "near_timestamp"]
        assert "hashpartitioning" not in near._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert shown(near) == want
        for pairs in (10**6, 0):
            monkeypatch.setattr(temporal, "BROADCAST_MOMENTS", 0)
            monkeypatch.setattr(temporal, "BROADCAST_SLOTS", pairs)
            assert shown(temporal.frames_near(moments, frames, 8.0)) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_scoring_holds_little_at_once():
    """600 components on 20,000 frames: what a task holds does not grow with the Arrow batch."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(2)
    vectors = lambda n: pa.array(list(rng.normal(size=(n, 16))), pa.list_(pa.float64()))
    names = pa.array([f"q{n // 3}" for n in range(600)])
    block = retrieval.QueryBlock(pa.table({"query_id": names, "component": pa.array([n % 3 for n in range(600)]), "embedding": vectors(600)}), 1.2)
    ids = pa.array([f"f{n:05d}" for n in range(20_000)])
    times = pa.array(np.arange(20_000.0))
    frames = pa.RecordBatch.from_arrays([ids, ids, ids, times, vectors(20_000)], [*retrieval.CARRIED, "embedding"])
    local = retrieval.LocalBest(block, 5, 0.0, "max")
    tracemalloc.start()
    local.add(frames)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert local.result().num_rows == 200 * 5
    assert peak < 60e6
