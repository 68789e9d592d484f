"""Nothing that was found is lost on the way to the result."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from kairoscope.functions.vectors import embed_text
from kairoscope.operators import audit, context, retrieval, temporal
from kairoscope.plans.search import search_moments
from kairoscope.schemas import STAMP_COLUMNS, SearchParams
from kairoscope.streaming import streams


STAMPS = {"dim": "32", "model": "m", "model_revision": "1", "preprocessing_version": "p", "indexing_version": "i"}


def stamped(vectors):
    return vectors.withColumns({name: F.lit(value) for name, value in STAMPS.items()})


def search(vectors, queries, media, *args, fine_vectors=None, **options):
    """A search of vectors that say which model they come from."""
    fine = None if fine_vectors is None else stamped(fine_vectors)
    return search_moments(stamped(vectors), queries, media, *args, fine_vectors=fine, stamps=STAMPS, **options)


@pytest.fixture(scope="module")
def index(spark):
    words = ["red car", "blue car", "red boat", "green tree", "red car road", "car"]
    rows = [(f"f{n}", f"v{n % 3}", "video", 50.0 * n, words[n % 6]) for n in range(18)]
    table = spark.createDataFrame(rows, "frame_id string, video_id string, media_type string, timestamp double, words string")
    media = spark.createDataFrame(
        [("v0", "zero.mp4", 5000.0), ("v1", "one.mp4", 20.0)], "video_id string, filename string, duration_seconds double"
    )
    empty = F.lit(None)
    media = media.withColumns({"width": empty.cast("int"), "height": empty.cast("int"), "uploaded_at": empty.cast("timestamp")})
    return embed_text(table, "words", 32).drop("words"), media, spark.createDataFrame([("q", "red car")], "query_id string, query string")


def test_no_result_is_lost(index):
    """v2 has no media row; v1 ends before most of its frames."""
    vectors, media, queries = index
    got = search(vectors, queries, media, SearchParams(final_results=18, group_window_s=0.0), "fast", dim=32).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 19))
    assert all(any(f["frame_id"] == r["frame_id"] for f in r["context_frames"]) for r in got)
    assert {r["video_name"] for r in got} == {"zero.mp4", "one.mp4", "v2"} and all(r["context_text"] for r in got)


def test_permutation_of_another_query_changes_nothing(index, spark):
    vectors, media, queries = index
    p = SearchParams(final_results=5)
    plain = search(vectors, queries, media, p, "fast", dim=32).collect()
    other = spark.createDataFrame([("else", "f0", 1)], "query_id string, frame_id string, new_rank int")
    got = search(vectors, queries, media, p, "fast", dim=32, permutation=other).collect()
    key = lambda rows: sorted((r["rank"], r["frame_id"]) for r in rows)
    assert key(got) == key(plain) and len(got) == 5
    late = SearchParams(final_results=5, sort_by="timestamp", sort_order="asc")
    got = sorted(search(vectors, queries, media, late, "fast", dim=32, permutation=other).collect(), key=lambda r: r["rank"])
    assert [r["timestamp"] for r in got] == sorted(r["timestamp"] for r in got)


def test_accepted_permutation_is_the_relevance(index, spark):
    vectors, media, queries = index
    p = SearchParams(final_results=50)
    plain = sorted(search(vectors, queries, media, p, "fast", dim=32).collect(), key=lambda r: r["rank"])
    n = len(plain)
    turned = spark.createDataFrame([("q", r["frame_id"], n + 1 - r["rank"]) for r in plain], "query_id string, frame_id string, new_rank int")
    got = search(vectors, queries, media, SearchParams(final_results=3), "fast", dim=32, permutation=turned)
    assert [r["frame_id"] for r in sorted(got.collect(), key=lambda r: r["rank"])] == [r["frame_id"] for r in plain[::-1][:3]]


def test_foreign_models_are_refused(index):
    vectors, media, queries = index
    stamps = {"dim": "32", "model": "m", "model_revision": "1", "preprocessing_version": "p", "indexing_version": "i"}
    assert set(stamps) == set(STAMP_COLUMNS)
    for name, value in stamps.items():
        vectors = vectors.withColumn(name, F.lit(value))
    mixed = vectors.withColumn("model", F.when(F.col("frame_id") == "f3", "other").otherwise(F.col("model")))
    assert search_moments(vectors, queries, media, mode="fast", dim=32, stamps=stamps).count() == 5
    with pytest.raises(ValueError):
        search_moments(mixed, queries, media, mode="fast", dim=32, stamps=stamps)
    allowed = SearchParams(final_results=50, group_window_s=0.0, allow_model_mismatch=True)
    got = search_moments(mixed, queries, media, allowed, "fast", dim=32, stamps=stamps)
    assert got.count() == 17 and got.filter("frame_id = 'f3'").isEmpty()


def test_unstamped_or_unexpected_indexes_are_refused(index):
    vectors, media, queries = index
    for given, stamps in ((vectors, STAMPS), (stamped(vectors), None), (stamped(vectors), {"model": "m"}), (stamped(vectors).drop("dim"), STAMPS)):
        with pytest.raises(ValueError, match="not known"):
            search_moments(given, queries, media, mode="fast", dim=32, stamps=stamps)
    with pytest.raises(ValueError):
        search_moments(stamped(vectors), queries, media, mode="accurate", dim=32, stamps=STAMPS, fine_vectors=vectors)
    allowed = SearchParams(allow_model_mismatch=True)
    assert search_moments(vectors, queries, media, allowed, "fast", dim=32).count() == 5


def test_results_without_a_date_come_last(index):
    """v2 has no media row, v0 and v1 no date: none is lost in the order by upload date."""
    vectors, media, queries = index
    dated = media.withColumn("uploaded_at", F.when(F.col("video_id") == "v1", F.lit("2024-01-01").cast("timestamp")))
    for order in ("asc", "desc"):
        p = SearchParams(final_results=50, group_window_s=0.0, sort_by="upload_date", sort_order=order)
        got = sorted(search(vectors, queries, dated, p, "fast", dim=32).collect(), key=lambda r: r["rank"])
        assert len(got) == 18 and {r["video_id"] for r in got[:6]} == {"v1"} and "v2" in {r["video_id"] for r in got[6:]}


def test_fine_match_is_shown_among_fine_frames(index, spark):
    vectors, media, queries = index
    fine = embed_text(
        spark.createDataFrame([("g1", "v0", "video", 3.0, "red car"), ("g2", "v0", "video", 6.0, "tree")],
                              "frame_id string, video_id string, media_type string, timestamp double, words string"), "words", 32
    ).drop("words")
    coarse = vectors.filter("video_id = 'v0'").withColumn("embedding", F.when(F.col("frame_id") == "f0", F.transform("embedding", lambda x: x * 0 + 1)).otherwise(F.col("embedding")))
    got = search(coarse, queries, media, SearchParams(final_results=50, fine_max_events=50), "accurate", dim=32, fine_vectors=fine)
    row = got.filter("frame_id = 'g1'").first()
    assert row["retrieval_stage"] == "fine" and {"g1", "g2"} <= {f["frame_id"] for f in row["context_frames"]}


def test_components_in_approximate_search(index, spark):
    vectors, _, _ = index
    comps = embed_text(spark.createDataFrame([("q", 0, "red car"), ("q", 1, "red"), ("q", 2, "tree")], "query_id string, component int, words string"), "words", 32)
    book = retrieval.fit_codebook(vectors, 3, parts=8)
    approximate = retrieval.approx_top_k(retrieval.index_vectors(vectors, book), comps, book, 10, n_probe=3)
    rows = lambda df: sorted((r["rank"], r["frame_id"], round(r["score"], 9)) for r in df.collect())
    assert rows(approximate) == rows(retrieval.top_k(vectors, comps, 10))


@pytest.mark.parametrize("descending", [True, False])
def test_keyset_pages_reach_null_keys(spark, descending):
    df = spark.createDataFrame([(i, i % 4 if i % 3 else None) for i in range(23)], "id int, k int")
    seen, last = [], None
    while rows := audit.keyset_page(df, "k", "id", last, 5, descending).collect():
        seen += [r["id"] for r in rows]
        last = (rows[-1]["k"], rows[-1]["id"])
    assert sorted(seen) == list(range(23)) and [i for i in seen if i % 3 == 0] == seen[-8:]


@pytest.mark.parametrize("limit", [None, 3])
def test_null_hashes_are_kept(spark, limit):
    big = 2**62 + 1
    rows = [("v", n, h) for n, h in enumerate([big, None, big, big ^ 0b111111, None, big ^ 0b111111, big])]
    df = spark.createDataFrame(rows, "video_id string, frame_id long, phash long")
    got = {r["frame_id"]: r["kept"] for r in temporal.dedup_greedy(df, ["frame_id"], 5, limit).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False, 6: True}


def test_context_of_a_match_behind_the_end(spark):
    moments = spark.createDataFrame([("q", "f9", "v", 90.0, 10.0, "video")], "query_id string, frame_id string, video_id string, timestamp double, duration double, media_type string")
    frames = spark.createDataFrame([("f9", "v", 90.0), ("f1", "v", 5.0)], "frame_id string, video_id string, timestamp double")
    row = context.with_context(moments, frames).first()
    assert [f["frame_id"] for f in row["context_frames"]] == ["f9"] and row["context_start"] == 90.0


def test_streams_resume(spark, tmp_path):
    schema = "job_id string, event_id long, ts timestamp, status string"
    for part in range(3):
        rows = [(f"j{n % 3}", 10 * part + n, dt.datetime(2024, 1, 1, part, n), f"s{part}") for n in range(9)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        log = streams.read_log(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_batch=1)
        out, progress = streams.drain(streams.latest_status(log), "complete", "latest", str(tmp_path / "job"))
        assert {r["status"] for r in out.collect()} == {f"s{part}"} and out.count() == 3
        assert sum(p["numInputRows"] for p in progress) == 9  # only what is new


def test_json_numbers(spark):
    from kairoscope.functions import text as X

    row = (
        "q", "a \"b\"", "video", 12.0, 1e-7, float("nan"), 0.5, "f", "coarse",
        [("f", 12.0, "00:00:12", "u")], None, "c", None, "00:00:12", None, None,
    )
    df = spark.createDataFrame(
        [row],
        "query string, video_name string, media_type string, timestamp double, context_start double, context_end double, similarity double, "
        "frame_id string, retrieval_stage string, context_frames array<struct<frame_id:string,timestamp:double,timestamp_hms:string,frame_url:string>>, "
        "context_reason string, context_text string, context_summary string, timestamp_hms string, context_start_hms string, context_end_hms string",
    )
    line = df.select(X.result_json()).first()[0]
    assert '"timestamp":12,' in line and '"start":1e-7,' in line and json.loads(line)["end"] is None
    assert json.loads(line)["media"] == 'a "b"' and json.loads(line)["context_frames"][0]["timestamp"] == 12


def test_reranker_gets_the_shortlist(index):
    """A function of the shortlist gives the same results as the table it would make."""
    vectors, media, queries = index
    p = SearchParams(final_results=4)
    seen = []

    def backwards(shortlist):
        seen.append(shortlist.count())
        return shortlist.select("query_id", "frame_id", (F.lit(seen[0] + 1) - F.col("rank")).alias("new_rank"))

    plain = search(vectors, queries, media, SearchParams(final_results=50), "fast", dim=32).collect()
    want = [r["frame_id"] for r in sorted(plain, key=lambda r: -r["rank"])][:4]
    got = sorted(search(vectors, queries, media, p, "fast", dim=32, permutation=backwards).collect(), key=lambda r: r["rank"])
    assert seen == [len(plain)] and [r["frame_id"] for r in got] == want
    assert {r["trace"]["rerank"] for r in got} == {"applied"}


def test_events_that_meet_in_a_fine_frame_give_one_result(index, spark):
    vectors, media, queries = index
    near = [("c1", "v0", "video", 10.0, "red"), ("c2", "v0", "video", 21.0, "red")]
    fine = [("best", "v0", "video", 15.0, "red car"), ("far", "v0", "video", 400.0, "tree")]
    schema = "frame_id string, video_id string, media_type string, timestamp double, words string"
    embedded = lambda rows: embed_text(spark.createDataFrame(rows, schema), "words", 32).drop("words")
    got = search(embedded(near), queries, media, SearchParams(), "accurate", dim=32, fine_vectors=embedded(fine)).collect()
    assert [(r["frame_id"], r["retrieval_stage"]) for r in got] == [("best", "fine")]


def test_alike_frames_do_not_fill_the_context(spark):
    moments = spark.createDataFrame(
        [("q", "f4", "v", 8.0, 100.0, "video")],
        "query_id string, frame_id string, video_id string, timestamp double, duration double, media_type string",
    )
    hashes = [0b0, 0b1, 0b1111000, 0b1111001, 0b0, 0b11, 0b1111000, None, 0b110000000]
    rows = [(f"f{i}", "v", 2.0 * i, h) for i, h in enumerate(hashes)]
    frames = spark.createDataFrame(rows, "frame_id string, video_id string, timestamp double, phash long")
    shown = lambda **kw: [f["frame_id"] for f in context.with_context(moments, frames, bins=9, **kw).first()["context_frames"]]
    assert shown() == [f"f{i}" for i in range(9)]
    # f0, f1 and f5 are like the match, f3 and f6 like f2; f8 is at 2 bits of the match.
    assert shown(near_bits=2) == ["f2", "f4", "f7"]
    assert shown(near_bits=1) == ["f2", "f4", "f5", "f7", "f8"]
    assert shown(near_bits=0) == ["f1", "f2", "f3", "f4", "f5", "f7", "f8"]
