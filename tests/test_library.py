"""Filters, audits, sinks and skewed joins on small literal tables."""

import datetime as dt
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kairoscope.operators import audit, evaluate, filters, skew, temporal
from kairoscope.plans import reports
from kairoscope.schemas import SearchParams
from kairoscope.sources import sinks, tables


def test_media_kind(spark):
    cases = [("a.MP4", None), ("a.png", "video/mp4"), ("a.mp4", "image/gif"), ("noext", ""), ("x.JPEG", ""), ("b.txt", ""), ("b.txt", "image/x")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n string, m string").orderBy("i")
    rows = df.select(filters.media_kind(F.col("n"), F.col("m")), filters.accepted_upload(F.col("n"), F.col("m")), filters.extension(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [
        ("video", True, ".mp4"), ("video", True, ".png"), ("image", True, ".mp4"), ("video", False, "t"),
        ("image", True, ".jpeg"), ("video", False, ".txt"), ("image", True, ".txt"),
    ]


def test_access(spark):
    users = spark.createDataFrame([("r", "ADMIN", "REVOKED"), ("a", "ADMIN", "ACTIVE"), ("e", "VIDEO_EDITOR", "ACTIVE"), ("s", "SEARCHER", None)], "uid string, role string, status string")
    calls = spark.createDataFrame([(u,) for u in "raesx"], "uid string")
    got = {r["uid"]: (r["admin_code"], r["editor_code"], r["searcher_code"]) for r in reports.access_audit(calls, users).collect()}
    assert got == {"r": (403,) * 3, "a": (200,) * 3, "e": (403, 200, 200), "s": (403, 403, 200), "x": (401,) * 3}


def test_ids_and_paths(spark):
    df = spark.createDataFrame([("a-1._B",), ("a/b",), ("",), ("../x",), ("/etc",), ("C:\\x",), ("a/../b",), ("a..b/c",)], "p string")
    rows = df.select("p", filters.valid_id(F.col("p")).alias("v"), filters.path_contained(F.col("p")).alias("c")).collect()
    assert {r["p"] for r in rows if r["v"]} == {"a-1._B"}
    assert {r["p"] for r in rows if r["c"]} == {"a-1._B", "a/b", "a..b/c"}


def test_search_filters(spark):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    media = spark.createDataFrame(
        [("a", "video", 10.0, "ready", day(1)), ("b", "video", None, "ready", day(2, 23)), ("c", "image", None, "failed", day(3)), ("d", "video", 99.0, "ready", None)],
        "video_id string, media_type string, duration_seconds double, status string, uploaded_at timestamp",
    )

    def ids(**kw):
        return "".join(sorted(r["video_id"] for r in filters.apply_filters(media, SearchParams(**kw)).collect()))

    assert ids() == "abcd"
    assert ids(date_from="2024-01-01", date_to="2024-01-02") == "ab"
    assert ids(date_to="2024-01-01") == "a"
    assert ids(min_duration=5) == "ad" and ids(max_duration=50) == "a"
    assert ids(media_type="video", status="ready") == "abd" and ids(media_types=("image",)) == "c"
    assert ids(video_ids=("a", "c")) == "ac"
    quick = media.filter(filters.quick_range("uploaded_at", 1, "2024-01-03"))
    assert sorted(r["video_id"] for r in quick.collect()) == ["b", "c"]


def test_upsert(spark):
    old = spark.createDataFrame([("1", "a@x", "ADMIN", "ACTIVE"), ("2", "b@x", "SEARCHER", "REVOKED")], "uid string, email string, role string, status string")
    new = spark.createDataFrame([("2", "new@x", "ADMIN", "ACTIVE", 1), ("2", "newer@x", "VIDEO_EDITOR", "ACTIVE", 2), ("3", "c@x", "SEARCHER", "ACTIVE", 1)], "uid string, email string, role string, status string, n int")
    got = sorted(tuple(r) for r in sinks.upsert(old, new, "uid", ["role", "status"], ["n"]).collect())
    assert got == [("1", "a@x", "ADMIN", "ACTIVE"), ("2", "b@x", "VIDEO_EDITOR", "ACTIVE"), ("3", "c@x", "SEARCHER", "ACTIVE")]


def test_deletes(spark):
    media = spark.createDataFrame([("a",), ("b",)], "video_id string")
    frames = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("z", 4)], "video_id string, f int")
    left, counts = sinks.cascade_delete({"media": media, "frames": frames}, media.filter("video_id = 'a'").union(media.filter("video_id = 'a'")), "video_id")
    assert {tuple(r) for r in counts.collect()} == {("media", 1, 1), ("frames", 2, 2)}
    assert sorted(r["f"] for r in left["frames"].collect()) == [3, 4]
    kept, deleted = sinks.delete_rows(frames, F.col("f") > 2)
    assert kept.count() == 2 and deleted.first()["deleted"] == 2


def test_chunks(spark):
    t = dt.datetime(2024, 1, 1)
    chunks = spark.createDataFrame(
        [("u", 0, "h", 5, t), ("u", 0, "h", 5, t), ("u", 1, "a", 5, t), ("u", 1, "b", 7, t), ("w", 0, "x", 4, t)],
        "upload_id string, idx int, sha256 string, size long, received_at timestamp",
    )
    got = {(r["upload_id"], r["idx"]): (r["writes"], r["outcome"]) for r in audit.chunk_conflicts(chunks).collect()}
    assert got == {("u", 0): (2, "replayed"), ("u", 1): (2, "conflict"), ("w", 0): (1, "single")}
    uploads = spark.createDataFrame([("u", 10, 3), ("w", 4, 1), ("e", 0, 0)], "upload_id string, file_size long, total_chunks long")
    rows = {r["upload_id"]: r for r in reports.upload_audit(uploads, chunks).collect()}
    assert rows["u"]["progress"] == pytest.approx(200 / 3) and rows["u"]["missing"] == 1 and rows["u"]["conflicts"] == 1
    assert rows["w"]["chunks_ok"] and rows["w"]["bytes_ok"] and rows["w"]["progress"] == 100
    assert rows["e"]["progress"] == 0 and rows["e"]["missing"] == 0


@pytest.mark.parametrize("limit", [None, 10])
def test_group_values_with_hot_key(spark, limit):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 20}") for i in range(200)], "id int, k string")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    got = skew.attach_group_values(rows, groups, ["k"], "n", "id", limit).collect()
    sizes = Counter(r["k"] for r in rows.collect())
    assert len(got) == 200 and all(r["n"] == sizes[r["k"]] for r in got)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = skew.attach_group_values(rows, groups, ["k"], "n", "id", limit)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"Exchange hashpartitioning\(k#\d+, _filler#\d+", plan)


@pytest.mark.parametrize("limit", [None, 5])
def test_identical_content(spark, limit):
    docs = spark.createDataFrame([(i, "same" if i < 30 else f"t{i}") for i in range(50)], "doc_id long, text string")
    got = temporal.content_copies(docs, "doc_id", "text", limit).collect()
    assert len(got) == 50 and sum(r["is_first"] for r in got) == 21
    assert {r["copies"] for r in got} == {1, 30} and {r["first_id"] for r in got if r["copies"] == 30} == {0}


def test_evaluation_counts_silent_queries(spark):
    golden = spark.createDataFrame([("a", "v1", 0.0, 5.0), ("b", "v2", 0.0, 5.0), ("c", "v3", 0.0, 5.0)], "query_id string, expected_video_id string, expected_start double, expected_end double")
    ranked = spark.createDataFrame([("a", 1, "v1", 3.0), ("b", 1, "v9", 1.0), ("b", 2, "v2", 50.0), ("b", 3, "v2", 6.0)], "query_id string, rank int, video_id string, timestamp double")
    r = evaluate.evaluate(ranked, golden, (1, 5), tolerance_s=1.0).first()
    assert r["queries"] == 3 and r["recall_at_1"] == pytest.approx(1 / 3) and r["recall_at_5"] == pytest.approx(2 / 3)
    assert r["mrr"] == pytest.approx((1 + 1 / 3) / 3) and r["video_recall"] == pytest.approx(2 / 3)
    assert r["temporal_accuracy"] == pytest.approx(0.5)


def test_keyset_pages_tile_the_table(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(23)], "id int, k int")
    seen, last = [], None
    while rows := audit.keyset_page(df, "k", "id", last, 5).collect():
        seen += [(r["k"], r["id"]) for r in rows]
        last = seen[-1]
    assert seen == sorted(((i % 4, i) for i in range(23)), reverse=True)
    assert [r["id"] for r in audit.page(df, [F.asc("id")], 3, 10).collect()] == [20, 21, 22]


def test_metrics(spark):
    df = spark.createDataFrame([("m", float(i)) for i in range(101)], "mode string, latency_ms double")
    exact = audit.latency_histogram(df, ["mode"], "latency_ms").first()
    assert (exact["count"], exact["mean"], exact["p95"]) == (101, 50.0, 95.0)
    sketch = audit.latency_histogram(df, ["mode"], "latency_ms", exact=False).first()
    assert abs(sketch["p95"] - 95.0) <= 1
    health = spark.createDataFrame([("n", "ok"), ("n", None), ("o", "ok")], "node string, status string")
    assert {r["node"]: r["health"] for r in audit.health(health, ["node"]).collect()} == {"n": "degraded", "o": "healthy"}


def test_history_filters_parse(spark):
    df = spark.createDataFrame([(1, '{"top_k": 7, "video_ids": ["a"]}'), (2, "broken"), (3, None)], "id long, filters string")
    got = {r["id"]: r["request"] for r in reports.parse_filters(df).collect()}
    assert got[1]["top_k"] == 7 and got[1]["video_ids"] == ["a"] and got[3] is None
    assert got[2] is None or got[2]["top_k"] is None


def test_file_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "a.MP4").write_bytes(b"x" * 10)
    (tmp_path / "b.txt").write_bytes(b"y")
    listed = tables.list_media_files(spark, str(tmp_path))
    assert {(r["filename"], r["size_bytes"], r["accepted"]) for r in listed.collect()} == {("a.MP4", 10, True), ("b.txt", 1, False)}
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_eta_columns_equal_their_sql(spark, tmp_path):
    """Jobs of tiny progress and without any, against the SQL."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    moments = [dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=7_001_003_117 * n % 2_500_000_000_000) for n in range(400)]
    rows = [(n, ts, n, "view", round(0.01 * (n % 40), 2), "{}") for n, ts in enumerate(moments)]
    columns = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in entry.queries()["w18_eta_columns"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    db.execute(f"create view events as select * replace (ts::timestamp as ts) from '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(db.execute(entry.oracle_sql()["w18_eta_columns"]).fetchall())
    assert {r[3] for r in got if r[1] == -1.0} == {float("inf")}
