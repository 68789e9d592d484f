"""Events, joins in time, frame sampling and deduplication."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine_pairs
from ..staging import stage
from .ordered import CHUNK, ordered_groups
from .skew import attach_group_values


# --- events over retrieved hits (at most top_k rows per query) ---------------------


def group_events(hits: DataFrame, window_s: float) -> DataFrame:
    """Add ``event_index``: a new event starts when the gap exceeds ``window_s``."""
    w = Window.partitionBy("query_id", "video_id").orderBy("timestamp", "frame_id")
    gap = F.col("timestamp") - F.lag("timestamp").over(w)
    starts = F.when(gap > window_s, 1).otherwise(0)
    return hits.withColumn("_start", starts).withColumn(
        "event_index", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    ).drop("_start")


def representatives(events: DataFrame, max_per_event: int = 1) -> DataFrame:
    """Best hits of each event, with the event's span and size."""
    event = Window.partitionBy("query_id", "video_id", "event_index")
    best = event.orderBy(F.desc("score"), F.asc("timestamp"), F.asc("frame_id"))
    return (
        events.withColumn("row_in_event", F.row_number().over(best))
        .withColumn("event_start", F.min("timestamp").over(event))
        .withColumn("event_end", F.max("timestamp").over(event))
        .withColumn("event_hits", F.count(F.lit(1)).over(event))
        .filter(F.col("row_in_event") <= max_per_event)
    )


# --- joins in time -----------------------------------------------------------------


def _slot(t: Column, width: float) -> Column:
    return F.floor(t / F.lit(width)).cast("long")


#: Moments (a few hundred bytes, in three slots each) that are broadcast at most; of more, only
#: their (video, slot) pairs, up to the second number, to leave frames out before they are shuffled.
BROADCAST_MOMENTS = 50_000
BROADCAST_SLOTS = 2_000_000


def frames_near(moments: DataFrame, frames: DataFrame, window_s: float, staged: bool = False) -> DataFrame:
    """Pair each moment with the frames of its video within ``window_s`` seconds.

    Time slots as wide as the window turn the range into an equality: a moment
    looks into at most three slots, a frame lives in one. The moments are staged (or
    ``staged`` already), so their number is known: few are broadcast, and the frames stay
    where they are; of many, the slots leave out all other frames before the join shuffles.
    ``moments`` needs ``video_id, timestamp``; frame columns come back prefixed ``near_``.
    """
    moments = moments if staged else stage(moments, "moments")
    slots = F.sequence(_slot(F.col("timestamp") - window_s, window_s), _slot(F.col("timestamp") + window_s, window_s))
    left = moments.withColumn("_slot", F.explode(slots))
    right = frames.select(*[F.col(c).alias(f"near_{c}") for c in frames.columns]).withColumn(
        "_near_slot", _slot(F.col("near_timestamp"), window_s)
    )
    if moments.count() <= BROADCAST_MOMENTS:
        left = F.broadcast(left)
    else:
        wanted = stage(left.select(F.col("video_id").alias("near_video_id"), F.col("_slot").alias("_near_slot")).distinct(), "slots")
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_SLOTS else wanted
        right = right.join(wanted, ["near_video_id", "_near_slot"], "left_semi")
    on = (
        (F.col("video_id") == F.col("near_video_id"))
        & (F.col("_slot") == F.col("_near_slot"))
        & F.col("near_timestamp").between(F.col("timestamp") - window_s, F.col("timestamp") + window_s)
    )
    return right.join(left, on).select(*moments.columns, *[f"near_{c}" for c in frames.columns])


def nearest_frame(moments: DataFrame, frames: DataFrame, window_s: float, keys: list[str]) -> DataFrame:
    """The other frame closest in time to each moment (ties: earlier, then smaller id)."""
    near = frames_near(moments, frames, window_s).filter(F.col("near_frame_id") != F.col("frame_id"))
    distance = F.abs(F.col("near_timestamp") - F.col("timestamp"))
    best = F.min_by(
        F.struct("near_frame_id", "near_timestamp"), F.struct(distance, "near_timestamp", "near_frame_id")
    )
    return near.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def latest_before(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str, tie: str,
    limit: int | None = None,
) -> DataFrame:
    """As-of join: add the ``value`` of the latest right row at or before each left row.

    One ordered pass over both inputs; ``value`` may be a struct column.
    ``tie`` is a column of ``left`` that makes its order total.
    """
    value_type = right.schema[value].dataType
    lefts = left.select(
        *keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.col(tie).cast("string").alias("_tie"),
        F.lit(None).cast(value_type).alias("_v"), F.struct(*left.columns).alias("_row"),
    )
    rights = right.select(
        *keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit("").alias("_tie"),
        F.col(value).alias("_v"), F.lit(None).cast(lefts.schema["_row"].dataType).alias("_row"),
    )
    both = ordered_groups(lefts.unionByName(rights), keys, ["_t", "_side", "_tie"], limit)
    return both.last_known("_found", "_v").result().filter(F.col("_side") == 1).select(
        "_row.*", F.col("_found").alias(value)
    )


# --- latest row, transitions, rates ------------------------------------------------


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key by partial aggregation; no window, so a hot key is no problem."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*")


# Allowed job state changes ('' stands for "no earlier state").
JOB_EDGES = (
    ("", "queued"),
    ("queued", "running"),
    ("queued", "cancelling"),
    ("running", "completed"),
    ("running", "failed"),
    ("running", "cancelling"),
    ("cancelling", "cancelled"),
)


def transition_allowed(before: Column, after: Column) -> Column:
    """Whether a job may move from ``before`` (null = no state yet) to ``after``."""
    before = F.coalesce(before, F.lit(""))
    edge = F.concat_ws(">", before, after)
    return (before == after) | edge.isin(*[f"{a}>{b}" for a, b in JOB_EDGES])


def validate_transitions(log: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """Add ``previous_status`` and ``allowed`` to a status log keyed by ``job_id``."""
    with_previous = ordered_groups(log, ["job_id"], order, limit).lag(previous_status="status").result()
    return with_previous.withColumn("allowed", transition_allowed(F.col("previous_status"), F.col("status")))


def upload_speed(
    chunks: DataFrame, keys: list[str], time_s: str, size: str, grid_s: float, samples: int = 10,
    limit: int | None = None,
) -> DataFrame:
    """Rolling mean of the last ``samples`` instantaneous rates on a time grid.

    One sample per grid cell: bytes of the cell over the time since the previous
    sample; the first sample of an upload has no rate.
    """
    cells = chunks.groupBy(*keys, F.floor(F.col(time_s) / grid_s).cast("long").alias("cell")).agg(
        F.max(time_s).alias("sample_s"), F.sum(size).alias("cell_bytes")
    )
    sampled = ordered_groups(cells, keys, ["cell"], limit).lag(_before="sample_s")
    elapsed = F.col("sample_s") - F.col("_before")
    rate = F.when(elapsed > 0, F.col("cell_bytes") / elapsed)
    rated = ordered_groups_with(sampled, sampled.df.withColumn("rate", rate))
    return rated.trailing(samples, speed=F.avg("rate")).result().drop("_before")


def ordered_groups_with(groups, df: DataFrame):
    """The same grouping over a derived frame that kept its chunk column."""
    return groups._next(df)


def upload_eta(size: Column, sent: Column, speed: Column) -> Column:
    return F.when(speed > 0, (size - sent) / speed)


def job_remaining_s(progress: Column, updated_at: Column, as_of: Column) -> Column:
    """Seconds left by linear extrapolation from ``updated_at``; null when unknown.

    Times are subtracted as seconds, as SQL's ``epoch`` gives them: a small progress carries the
    last bits of the difference up into the milliseconds.
    """
    elapsed = F.unix_micros(as_of) / 1e6 - F.unix_micros(updated_at) / 1e6
    remaining = elapsed / (progress / 100) - elapsed
    known = (progress > 0) & (elapsed > 0)
    return F.when(known, F.when(remaining >= 0, remaining))


def reconcile(latest: DataFrame, requeue: bool = False) -> DataFrame:
    """After a crash: interrupted jobs fail (or are queued again); adds ``rollback``."""
    interrupted = F.col("status").isin("running", "cancelling")
    target = "queued" if requeue else "failed"
    return latest.withColumn("new_status", F.when(interrupted, target).otherwise(F.col("status"))).withColumn(
        "rollback", interrupted
    )


def rollback_vectors(vectors: DataFrame, settled: DataFrame) -> DataFrame:
    """Vectors of the jobs that :func:`reconcile` rolls back.

    The job list is staged, so the join sees two plain shuffles and a job with
    very many vectors is split by the runtime skew join.
    """
    jobs = stage(settled.filter("rollback").select("job_id"), "rollback")
    return vectors.join(jobs, "job_id", "left_semi")


# --- sampling and deduplication ----------------------------------------------------


def sampling_plan(media: DataFrame, interval_s: float) -> DataFrame:
    """One planned frame every ``interval_s`` seconds of each item."""
    steps = F.sequence(F.lit(0).cast("long"), F.floor(F.col("duration_seconds") / interval_s).cast("long"))
    return media.filter(F.col("duration_seconds").isNotNull()).select(
        "video_id", F.explode(steps).alias("frame_index")
    ).withColumn("timestamp", F.col("frame_index") * F.lit(float(interval_s)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dedup_adjacent(
    frames: DataFrame, order: list[str], max_hamming: int = 5, limit: int | None = None
) -> DataFrame:
    """Add ``kept``: false when the hash is close to the previous frame's hash."""
    with_previous = ordered_groups(frames, ["video_id"], order, limit).lag(_before="phash").result()
    far = hamming(F.col("phash"), F.col("_before")) > max_hamming
    return with_previous.withColumn("kept", F.coalesce(far, F.lit(True))).drop("_before")


def dedup_embedding(
    frames: DataFrame, order: list[str], min_cosine: float = 0.98, limit: int | None = None
) -> DataFrame:
    """Add ``cosine_to_previous`` and ``kept`` (false when the cosine reaches the limit)."""
    with_previous = ordered_groups(frames, ["video_id"], order, limit).lag(_before="embedding").result()
    scored = with_previous.withColumn("cosine_to_previous", cosine_pairs("embedding", "_before"))
    kept = F.coalesce(F.col("cosine_to_previous") < min_cosine, F.lit(True))
    return scored.withColumn("kept", kept).drop("_before")


def dedup_greedy(
    frames: DataFrame, order: list[str], max_hamming: int = 5, limit: int | None = None
) -> DataFrame:
    """Add ``kept``: a frame is kept when its hash is far from the last kept frame.

    Each run starts from the hash its predecessor run ended with. Runs of a hot
    video first start from nothing; runs whose true entry differs are repeated
    until no entry changes, so the outcome equals the sequential rule. A frame without
    a hash is kept and leaves the last kept hash as it is.
    """
    # Hashes travel as text: a null would turn the 64-bit integers into floats.
    texts = frames.withColumn("_hash", F.col("phash").cast("string")).drop("phash")
    groups = ordered_groups(texts, ["video_id"], order, limit)
    keys = ["video_id", CHUNK]
    out_schema = T.StructType([*frames.schema.fields, T.StructField("kept", T.BooleanType())])
    run_schema = T.StructType([*texts.schema.fields, T.StructField("kept", T.BooleanType()), T.StructField(CHUNK, T.IntegerType())])

    def run(rows: pd.DataFrame, entry: int | None) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        last, flags = entry, []
        for text in rows["_hash"].tolist():
            h = None if text is None else int(text)
            keep = h is None or last is None or ((h ^ last) & 0xFFFFFFFFFFFFFFFF).bit_count() > max_hamming
            last = h if keep and h is not None else last
            flags.append(keep)
        return rows.assign(kept=flags)

    hashed = F.col("_hash").cast(frames.schema["phash"].dataType)
    if not groups.split:
        tagged = groups.df.groupBy(*keys).applyInPandas(lambda rows: run(rows, None), run_schema)
        return tagged.withColumn("phash", hashed).select(*out_schema.fieldNames())

    def resume(rows: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or entries.empty:
            return pd.DataFrame(columns=run_schema.fieldNames()).astype({CHUNK: "int32"})
        entry = entries["entry"].iloc[0]
        return run(rows, None if pd.isna(entry) else int(entry))

    data = groups.df
    cold = data.filter(F.col(CHUNK) < 0).groupBy(*keys).applyInPandas(lambda rows: run(rows, None), run_schema)
    hot = data.filter(F.col(CHUNK) >= 0)
    entries = hot.select(*keys).distinct().withColumn("entry", F.lit(None).cast("string"))
    todo = entries = stage(entries, "entries")
    done: DataFrame | None = None
    while not todo.isEmpty():
        redone = hot.groupBy(*keys).cogroup(todo.groupBy(*keys)).applyInPandas(resume, run_schema)
        if done is not None:
            redone = done.join(F.broadcast(todo.select(*keys)), keys, "left_anti").unionByName(redone)
        done = stage(redone, "runs")
        last = F.max_by(F.col("_hash"), F.when(F.col("kept") & F.col("_hash").isNotNull(), F.struct(*order))).alias("last")
        ends = done.groupBy(*keys).agg(last)
        along = Window.partitionBy("video_id").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        true_entry = F.last("last", ignorenulls=True).over(along).cast("string")
        fresh = ends.withColumn("entry", true_entry).select(*keys, "entry")
        old = entries.withColumnRenamed("entry", "_old")
        todo = stage(
            fresh.join(old, keys).filter(~F.col("entry").eqNullSafe(F.col("_old"))).select(*keys, "entry"), "entries"
        )
        entries = stage(fresh, "entries")
    return cold.unionByName(done).withColumn("phash", hashed).select(*out_schema.fieldNames())


def content_copies(files: DataFrame, id_col: str, content: str, limit: int | None = None) -> DataFrame:
    """Byte-identical files: SHA-256, first id and size of each item's group.

    Groups are aggregated before the shuffle and attached to the rows without
    ever gathering the copies of one file.
    """
    hashed = files.select(F.col(id_col), F.sha2(F.encode(F.col(content), "UTF-8"), 256).alias("sha256"))
    groups = hashed.groupBy("sha256").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("copies"))
    found = attach_group_values(hashed, groups, ["sha256"], "copies", id_col, limit)
    return found.withColumn("is_first", F.col(id_col) == F.col("first_id"))
