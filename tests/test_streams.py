"""Streams over several micro-batches equal their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kairoscope.operators import temporal
from kairoscope.streaming import streams


def write_parts(spark, rows, schema, path, parts):
    """One file per part, written in order so that the stream reads them in order."""
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture(scope="module")
def job_log(spark, tmp_path_factory):
    rng = random.Random(2)
    states = ["queued", "running", "completed", "failed", "cancelling", "cancelled"]
    start = dt.datetime(2024, 1, 1)
    rows = [(f"j{rng.choice([0, 0, 1, 2, 3])}", i, start + dt.timedelta(minutes=i), rng.choice(states)) for i in range(240)]
    path = str(tmp_path_factory.mktemp("log"))
    write_parts(spark, rows, "job_id string, event_id long, ts timestamp, status string", path, 4)
    return path, spark.read.parquet(path)


STATUS_LOG = "job_id string, event_id long, ts timestamp, status string"


def invalid(table, until=None):
    found = temporal.validate_transitions(table, ["ts", "event_id"]).filter("not allowed")
    found = found.filter(F.col("ts") <= until) if until else found
    return sorted((r.event_id, r.previous_status or "") for r in found.collect())


def test_transitions_in_order_of_time_whatever_the_arrival(spark, job_log, tmp_path):
    """Rows up to 50 minutes late, several batches, a stop and a resumption after each of two halves."""
    _, table = job_log
    rng = random.Random(5)
    rows = sorted((tuple(r) for r in table.collect()), key=lambda r: r[1] + rng.randrange(50))
    assert [r[1] for r in rows] != sorted(r[1] for r in rows)
    latest = dt.datetime(2024, 1, 1)
    for half in (rows[:130], rows[130:]):
        write_parts(spark, half, STATUS_LOG, str(tmp_path / "in"), 2)
        log = streams.read_log(spark, str(tmp_path / "in"), table.schema, files_per_batch=1)
        out = streams.transition_stream(log, "60 minutes", str(tmp_path / "job"))
        latest = max([latest, *[r[2] for r in half]])
        got = sorted((r.event_id, r.previous_status or "") for r in out.collect())
        assert got == invalid(table, latest - dt.timedelta(minutes=60))
    assert len(got) > 20


def test_transitions_refuse_rows_behind_the_watermark(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    at = lambda m: start + dt.timedelta(minutes=m)
    parts = [
        [("j", 1, at(0), "queued"), ("j", 2, at(10), "running"), ("j", 3, at(600), "completed")],
        [("j", 4, at(5), "failed"), (None, 9, at(601), "queued"), ("j", 5, None, "failed"), ("j", 6, at(900), None)],
        [("j", 7, at(2000), "queued"), ("j", 8, at(500), "failed")],
    ]
    for n, part in enumerate(parts):
        write_parts(spark, part, STATUS_LOG, str(tmp_path / "in"), 1)
    schema = spark.createDataFrame([], STATUS_LOG).schema
    out = streams.transition_stream(streams.read_log(spark, str(tmp_path / "in"), schema, files_per_batch=1), "60 minutes")
    # Event 4 comes before anything was judged; event 8 comes after the watermark has passed it.
    assert sorted((r.event_id, r.previous_status) for r in out.collect()) == [(2, "failed"), (4, "queued"), (6, "completed")]


def test_latest_status(spark, job_log):
    path, table = job_log
    out, progress = streams.drain(streams.latest_status(streams.read_log(spark, path, table.schema, files_per_batch=1)), "complete", "latest")
    want = temporal.latest_per_key(table, ["job_id"], ["ts", "event_id"])
    assert {(r["job_id"], r["event_id"]) for r in out.collect()} == {(r["job_id"], r["event_id"]) for r in want.collect()}
    assert len([p for p in progress if p["numInputRows"]]) == 4


def test_chunk_replays_across_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("u", i % 10, f"h{i % 10}", start + dt.timedelta(minutes=i)) for i in range(40)]
    rows[35] = ("u", 5, "other", rows[35][3])
    schema = "upload_id string, idx int, sha256 string, received_at timestamp"
    write_parts(spark, rows, schema, str(tmp_path / "in"), 4)
    log = streams.read_log(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_batch=1)
    out, _ = streams.drain(streams.accepted_chunks(log, "1 day"), "append", "chunks")
    got = sorted((r["idx"], r["sha256"]) for r in out.collect())
    assert got == sorted([(i, f"h{i}") for i in range(10)] + [(5, "other")])


def test_index_replay_adds_nothing(spark, tmp_path):
    rows = [(f"f{i % 25}", float(i % 25)) for i in range(40)]
    write_parts(spark, rows, "frame_id string, x double", str(tmp_path / "in"), 3)
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    embed = lambda df: df.select("frame_id", F.array("x").alias("embedding"))
    for _ in range(2):
        streams.index_stream(streams.read_log(spark, str(tmp_path / "in"), schema, files_per_batch=1), embed, str(tmp_path / "index"))
        assert sorted(r["frame_id"] for r in spark.read.parquet(str(tmp_path / "index")).collect()) == sorted(f"f{i}" for i in range(25))


def test_update_mode_keeps_the_last_version(spark, job_log):
    path, table = job_log
    stream = streams.latest_status(streams.read_log(spark, path, table.schema, files_per_batch=1))
    out, _ = streams.drain(stream, "update", "latest", keys=["job_id"])
    want = temporal.latest_per_key(table, ["job_id"], ["ts", "event_id"])
    assert out.columns == ["job_id", "status", "event_id"]
    assert {(r["job_id"], r["event_id"]) for r in out.collect()} == {(r["job_id"], r["event_id"]) for r in want.collect()}
    with pytest.raises(ValueError):
        streams.drain(stream, "update", "latest")


def test_index_reads_only_the_folders_of_a_batch(spark, tmp_path):
    rows = [(f"f{i}", [float(i), 1.0]) for i in range(40)]
    write_parts(spark, rows, "frame_id string, embedding array<double>", str(tmp_path / "in"), 4)
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    index = str(tmp_path / "index")
    streams.index_stream(streams.read_log(spark, str(tmp_path / "in"), schema, files_per_batch=1), lambda df: df, index, buckets=8)
    assert {r.frame_id: r.embedding for r in spark.read.parquet(index).collect()} == dict(rows)
    # A folder that no arriving key belongs to may even be unreadable.
    key = F.pmod(F.xxhash64(F.lit("f0")), F.lit(8)).cast("int")
    touched = spark.range(1).select(key.alias("b")).first().b
    other = next(p for p in (tmp_path / "index").glob("bucket=*") if p.name != f"bucket={touched}")
    for file in other.glob("*.parquet"):
        file.write_bytes(b"broken")
    write_parts(spark, rows[:1], "frame_id string, embedding array<double>", str(tmp_path / "again"), 1)
    streams.index_stream(streams.read_log(spark, str(tmp_path / "again"), schema), lambda df: df, index, buckets=8)
    assert spark.read.parquet(index).filter(F.col("bucket") == touched).groupBy("frame_id").count().filter("count > 1").isEmpty()


def test_late_rows_are_split_exactly(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    at = lambda m: start + dt.timedelta(minutes=m)
    batches = [[("a", at(i)) for i in range(0, 300, 10)], [("a", at(250)), ("a", at(200)), ("a", at(10)), ("a", at(10)), ("b", at(100))], [("b", at(239)), ("b", at(400)), ("b", None)]]
    schema = spark.createDataFrame([], "name string, ts timestamp").schema
    kept_all, late_all = [], []
    for n in range(3):
        write_parts(spark, batches[n], "name string, ts timestamp", str(tmp_path / "in"), 1)
        kept, late = streams.split_late(streams.read_log(spark, str(tmp_path / "in"), schema, files_per_batch=1), "1 hour", "30 minutes", str(tmp_path / "job"))
        passed = max((t for b in batches[:n] for _, t in b if t), default=None)
        for row in batches[n]:
            end = row[1] and row[1].replace(minute=0) + dt.timedelta(hours=1)
            refused = passed is not None and end is not None and end <= passed - dt.timedelta(minutes=30)
            (late_all if refused else kept_all).append(row)
        show = lambda df: sorted(str((r["name"], r["ts"])) for r in df.collect())
        assert show(late) == sorted(str(r) for r in late_all) and show(kept) == sorted(str(r) for r in kept_all)
    assert len(late_all) == 5


def test_windows_and_late_rows(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    on_time = [("m", start + dt.timedelta(minutes=i), 1.0) for i in range(600)]
    late = [("m", start + dt.timedelta(minutes=i), 1.0) for i in range(5)]
    path = str(tmp_path / "in")
    write_parts(spark, on_time, "name string, ts timestamp, value double", path, 3)
    write_parts(spark, late, "name string, ts timestamp, value double", path, 1)
    schema = spark.read.parquet(path).schema
    log = streams.read_log(spark, path, schema, files_per_batch=1)
    out, progress = streams.drain(streams.windowed_latency(log, "value", "1 hour", late="10 minutes"), "append", "w")
    rows = out.collect()
    assert {r["n"] for r in rows} == {60} and len(rows) in (8, 9)
    assert streams.dropped_late_rows(progress) >= 1
    complete, _ = streams.drain(streams.windowed_latency(log, "value", "2 hours", "1 hour"), "complete", "w2")
    assert complete.agg(F.sum("n")).first()[0] == 2 * 605
