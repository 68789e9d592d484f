"""Context segments: representative frames around each moment, with reason and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..staging import stage
from .temporal import frames_near


def frame_url(video_id: Column, frame_id: Column) -> Column:
    return F.concat(F.lit("frames/"), video_id, F.lit("/"), frame_id, F.lit(".jpg"))


def segment_window(timestamp: Column, duration: Column, window_s: float) -> tuple[Column, Column]:
    """The plain window, clamped to the item."""
    low = F.greatest(F.lit(0.0), timestamp - window_s)
    high = F.least(F.coalesce(duration, timestamp + window_s), timestamp + window_s)
    return low, high


def with_context(
    moments: DataFrame, frames: DataFrame, window_s: float = 8.0, bins: int = 5, segment: str = "evidence",
    near_bits: int | None = None,
) -> DataFrame:
    """Add ``context_frames``, ``context_start`` and ``context_end`` to video moments.

    ``moments``: one row per (query_id, frame_id) with ``video_id, timestamp,
    duration, media_type``. The window is cut into ``bins`` parts; each keeps the
    frame nearest its centre, and the match always stays. Both steps aggregate
    partially, so frames that crowd one window never meet in one task. A match
    without neighbours, or behind the end of its item, keeps itself as its only frame.
    With ``near_bits``, ``frames`` carry a perceptual hash ``phash`` and a part's frame is left
    out when it differs in no more bits from the match or an earlier part's frame; frames
    without a hash resemble none.
    """
    low, high = segment_window(F.col("timestamp"), F.col("duration"), window_s)
    keys = ["query_id", "frame_id"]
    packed = moments.select(
        *keys, "video_id", "timestamp", low.alias("_low"), high.alias("_high"), F.struct(*moments.columns).alias("_m")
    )
    # Read twice below; staged so that the moments are found once.
    packed = stage(packed, "moments")
    shown = ["frame_id", "video_id", "timestamp"] + (["phash"] if near_bits is not None else [])
    near = frames_near(packed, frames.select(*shown), window_s, staged=True)
    if near_bits is None:
        near = near.withColumn("near_phash", F.lit(None).cast("long"))
    near = near.filter(F.col("near_timestamp").between(F.col("_low"), F.col("_high")))
    width = (F.col("_high") - F.col("_low")) / bins
    part = F.least(F.lit(bins - 1), F.floor((F.col("near_timestamp") - F.col("_low")) / width).cast("int"))
    binned = near.withColumn("_bin", F.when(width > 0, part).otherwise(F.lit(0)))
    centre = F.col("_low") + (F.col("_bin") + 0.5) * width
    distance = F.round(F.abs(F.col("near_timestamp") - centre), 9)
    frame = F.struct(
        F.col("near_timestamp").alias("timestamp"), F.col("near_frame_id").alias("frame_id"), F.col("near_phash").alias("phash")
    )
    chosen = binned.groupBy(*keys, "_bin").agg(
        F.min_by(frame, F.struct(distance, "near_timestamp", "near_frame_id")).alias("_frame"),
        F.first("_m").alias("_m"),
        F.max(F.when(F.col("near_frame_id") == F.col("frame_id"), F.col("near_phash"))).alias("_own"),
    )
    nothing = F.lit(None).cast("long")
    match = F.struct(F.col("_m.timestamp").alias("timestamp"), F.col("frame_id"), nothing.alias("phash"))
    # Every moment counts as a part of its own, so none is lost with its window.
    own = packed.select(*keys, F.lit(-1).alias("_bin"), match.alias("_frame"), "_m", nothing.alias("_own"))
    chosen = chosen.unionByName(own)
    gathered = chosen.groupBy(*keys).agg(F.collect_list("_frame").alias("_frames"), F.first("_m").alias("_m"), F.max("_own").alias("_own"))
    # At most one frame a part: the match first, the others in order of time.
    match = F.struct(F.col("_m.timestamp").alias("timestamp"), F.col("frame_id"), F.col("_own").alias("phash"))
    others = F.array_sort(F.filter("_frames", lambda f: f["frame_id"] != F.col("frame_id")))
    if near_bits is None:
        spread = F.concat(F.array(match), others)
    else:
        alike = lambda f: lambda kept: F.bit_count(kept["phash"].bitwiseXOR(f["phash"])) <= near_bits
        spread = F.aggregate(
            others, F.array(match),
            lambda kept, f: F.when(F.coalesce(F.exists(kept, alike(f)), F.lit(False)), kept).otherwise(F.array_append(kept, f)),
        )
    listed = gathered.withColumn("_picked", F.array_sort(spread))
    plain_low, plain_high = segment_window(F.col("_m.timestamp"), F.col("_m.duration"), window_s)
    if segment == "window":
        start, end = plain_low, plain_high
    else:
        start, end = F.col("_picked")[0]["timestamp"], F.element_at("_picked", -1)["timestamp"]
    video = F.col("_m.media_type") == "video"
    return listed.select(
        "_m.*",
        F.transform(
            "_picked",
            lambda f: F.struct(
                f["frame_id"].alias("frame_id"),
                f["timestamp"].alias("timestamp"),
                X.format_hms(f["timestamp"]).alias("timestamp_hms"),
                frame_url(F.col("_m.video_id"), f["frame_id"]).alias("frame_url"),
            ),
        ).alias("context_frames"),
        F.when(video, start).alias("context_start"),
        F.when(video, end).alias("context_end"),
    )


def with_text(results: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Add hms fields, reason, optional supplied summary and the evidence block."""
    if summaries is not None:
        results = results.join(summaries.select("query_id", "frame_id", "context_summary"), ["query_id", "frame_id"], "left")
    else:
        results = results.withColumn("context_summary", F.lit(None).cast("string"))
    clock = lambda c: F.when(F.col(c).isNotNull(), X.format_hms(F.col(c)))
    described = (
        results.withColumn("timestamp_hms", X.format_hms(F.col("timestamp")))
        .withColumn("context_start_hms", clock("context_start"))
        .withColumn("context_end_hms", clock("context_end"))
        .withColumn("duration_hms", clock("duration"))
        .withColumn(
            "context_reason",
            X.reason_text(F.col("frame_id"), F.col("raw_similarity"), F.size("context_frames")),
        )
        .withColumn("context_text", F.lit(None).cast("string"))
    )
    return described.withColumn("context_text", X.context_text())
