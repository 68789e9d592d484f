"""Streams over the event and chunk logs, each compared with its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairoscope.staging import new_path
from kairoscope.streaming import streams

from . import sql as S
from . import views as V
from .audit_queries import TRANSITIONS
from .registry import query
from .views import table


#: Batches that a table is split into by the time its rows arrive.
PARTS = 3


def _arriving(rows, arrival, files=2):
    """The rows as a stream of ``PARTS`` batches in order of ``arrival``, a column of microseconds."""
    spark = rows.sparkSession
    timed = rows.withColumn("_at", arrival)
    low, high = timed.agg(F.min("_at"), F.max("_at")).first()
    part = F.least(F.lit(PARTS - 1), F.expr(f"(_at - {low}L) * {PARTS} div {max(1, high - low)}L"))
    path = new_path(spark, "arriving")
    for n in range(PARTS):
        timed.filter(part == n).drop("_at").repartition(files).write.mode("append").parquet(path)
    return streams.read_log(spark, path, rows.schema, files_per_batch=files)


def _timed_events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _events(spark, d):
    return _arriving(_timed_events(spark, d), F.unix_micros("ts"))


DAY = 86_400_000_000


def _late_events(spark, d):
    """Errors arrive a day after they happen."""
    delay = F.when(F.col("event_type") == "error", F.lit(DAY)).otherwise(F.lit(0))
    return _arriving(_timed_events(spark, d), F.unix_micros("ts") + delay)


# What the watermark has passed when all input is read.
PASSED = "(select date_trunc('milliseconds', max(ts)) - interval 1 hour from events)"


TEXT = "yyyy-MM-dd HH:mm:ss"


def _shown(windows):
    total = F.round(F.col("mean") * F.col("n"), 2).alias("total_ms")
    return windows.select(F.date_format("window_start", TEXT).alias("window_start"), "name", "n", total)


@query(
    "g1_latest_status_stream",
    f"with {TRANSITIONS} select job_id, status, event_id from jobs qualify row_number() over (partition by job_id order by ts desc, event_id desc) = 1",
)
def g1(spark, d):
    log = V.as_job_log(_late_events(spark, d))
    return streams.drain(streams.latest_status(log), "update", "latest-status", keys=["job_id"])[0]


@query(
    "g2_tumbling_latency_stream",
    f"""select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') window_start, event_type as name, count(*) n, round(sum(value), 2) total_ms
    from events where time_bucket(interval 1 hour, ts) + interval 1 hour <= {PASSED} group by 1, 2""",
)
def g2(spark, d):
    log = _events(spark, d).withColumn("name", F.col("event_type"))
    out, _ = streams.drain(streams.windowed_latency(log, "value", "1 hour"), "append", "tumbling")
    return _shown(out)


@query(
    "g3_sliding_counter_stream",
    f"""with w as (select event_type as name, value, unnest([time_bucket(interval 6 hour, ts), time_bucket(interval 6 hour, ts) - interval 6 hour]) s from events)
    select strftime(s, '%Y-%m-%d %H:%M:%S') window_start, name, count(*) n, round(sum(value), 2) total_ms from w
    where s + interval 12 hour <= {PASSED} group by 1, 2""",
)
def g3(spark, d):
    log = _events(spark, d).withColumn("name", F.col("event_type"))
    out, _ = streams.drain(streams.windowed_latency(log, "value", "12 hours", "6 hours"), "append", "sliding")
    return _shown(out)


@query(
    "g4_session_stream",
    f"""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 4 hour then 0 else 1 end s from events),
    i as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) k from g)
    select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') session_start, count(*) n from i group by user_id, k
    having max(ts) + interval 4 hour <= {PASSED}""",
)
def g4(spark, d):
    out, _ = streams.drain(streams.sessions(_events(spark, d), "user_id", "4 hours"), "append", "sessions")
    return out.select("user_id", F.date_format("session_start", TEXT).alias("session_start"), "n")


@query(
    "g5_chunk_dedup_stream",
    "select distinct l_orderkey upload_id, (l_linenumber - 1)::bigint idx, sha256(l_quantity::int::varchar) sha256 from lineitem",
)
def g5(spark, d):
    chunks = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("upload_id"), (F.col("l_linenumber") - 1).cast("long").alias("idx"),
        F.sha2(F.col("l_quantity").cast("int").cast("string"), 256).alias("sha256"),
        F.col("l_shipdate").cast("timestamp").alias("received_at"),
    )
    log = _arriving(chunks, F.unix_micros("received_at"))
    out, _ = streams.drain(streams.accepted_chunks(log, "3650 days"), "append", "chunk-dedup")
    return out.select("upload_id", "idx", "sha256")


# Errors come a day late, within the two days that the watermark waits.
@query(
    "g6_transition_stream",
    f"""with {TRANSITIONS} select job_id, event_id, status, coalesce(previous, 'none') previous_status from tt join events using (event_id)
    where not allowed and events.ts <= (select date_trunc('milliseconds', max(ts)) - interval 2 day from events)""",
)
def g6(spark, d):
    out = streams.transition_stream(V.as_job_log(_late_events(spark, d)), "2 days")
    return out.select("job_id", "event_id", "status", F.coalesce("previous_status", F.lit("none")).alias("previous_status"))


@query(
    "g7_incremental_index_stream",
    f"""with {S.FRAMES} select frame_id, video_id, len(embedding)::bigint dim, round(embedding[1]::double, 6) first_value, round(embedding[64]::double, 6) last_value
    from frames""",
)
def g7(spark, d):
    frames = table(spark, d, "embeddings").withColumn("frame_id", F.col("vec_id").cast("string"))
    arriving = _arriving(frames, F.col("vec_id").cast("long"))
    path = new_path(spark, "index")
    for _ in range(2):  # the replay must add nothing
        streams.index_stream(arriving, lambda new: new.select("frame_id", V.video_id().alias("video_id"), "embedding"), path)
    value = lambda n: F.round(F.element_at("embedding", n).cast("double"), 6)
    stored = spark.read.parquet(path)
    return stored.select("frame_id", "video_id", F.size("embedding").cast("long").alias("dim"), value(1).alias("first_value"), value(-1).alias("last_value"))


@query(
    "g8_late_rows_stream",
    f"""with a as (select *, epoch_us(ts) + case event_type when 'error' then {DAY} else 0 end arrived from events),
    p as (select *, least({PARTS - 1}, (arrived - min(arrived) over ()) * {PARTS} // (max(arrived) over () - min(arrived) over ())) part from a),
    m as (select part, max(ts) latest from p group by part),
    w as (select p.*, (select max(latest) - interval 1 hour from m where m.part < p.part) passed from p)
    select event_type as name, count(*) filter (not late) in_time_rows, count(*) filter (late) refused_rows
    from (select *, coalesce(time_bucket(interval 1 hour, ts) + interval 1 hour <= passed, false) late from w) group by 1""",
)
def g8(spark, d):
    kept, refused = streams.split_late(_late_events(spark, d).withColumn("name", F.col("event_type")), "1 hour", "1 hour")
    both = kept.select("name", F.lit(0).alias("late")).unionByName(refused.select("name", F.lit(1).alias("late")))
    return both.groupBy("name").agg(F.count_if(F.col("late") == 0).alias("in_time_rows"), F.count_if(F.col("late") == 1).alias("refused_rows"))
