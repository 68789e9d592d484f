"""Ready-made reports assembled from the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit, filters, temporal
from ..schemas import SEARCH_REQUEST

# How many recent rows each list shows.
RECENT = {"jobs": 50, "jobs_panel": 8, "contexts": 100, "history": 8, "frames": 60}
SORTS = {"uploaded_at": "uploaded_at", "original_filename": "filename", "size_bytes": "size_bytes"}


@dataclass(frozen=True)
class LibraryRequest:
    search: str = ""
    sort_by: str = "uploaded_at"
    sort_order: str = "desc"
    page: int = 1
    page_size: int = 24


def library_report(media: DataFrame, r: LibraryRequest = LibraryRequest()) -> DataFrame:
    """One page of the library with size and duration text and the total match count."""
    if r.sort_by not in SORTS:
        raise ValueError(f"cannot sort by {r.sort_by!r}")
    found = media.filter(filters.library_search(r.search))
    keys = [SORTS[r.sort_by], "video_id"]
    order = [F.desc(k) if r.sort_order == "desc" else F.asc(k) for k in keys]
    total = found.agg(F.count(F.lit(1)).alias("total")).scalar()
    return (
        audit.page(found, order, r.page, r.page_size)
        .withColumn("total", total)
        .withColumn("size_text", X.format_bytes(F.col("size_bytes")))
        .withColumn("duration_hms", X.format_hms(F.col("duration_seconds")))
    )


def first_frames(frames: DataFrame, n: int = RECENT["frames"]) -> DataFrame:
    """Per item: frame count, last offset and the first ``n`` frames as an array.

    Frames are cut to ``n`` per (item, salt), then per item, before they are
    gathered: no task sorts all frames of one item, and each array stays small.
    """
    from pyspark.sql import Window

    by_time = [F.asc("timestamp"), F.asc("frame_id")]
    slim = frames.select("video_id", "frame_id", "timestamp")
    part = Window.partitionBy("video_id", "_salt").orderBy(*by_time)
    whole = Window.partitionBy("video_id").orderBy(*by_time)
    head = (
        slim.withColumn("_salt", F.pmod(F.hash("frame_id"), F.lit(64)))
        .withColumn("_r", F.row_number().over(part))
        .filter(F.col("_r") <= n)
        .withColumn("_r", F.row_number().over(whole))
        .filter(F.col("_r") <= n)
    )
    listed = head.groupBy("video_id").agg(
        F.array_sort(F.collect_list(F.struct("timestamp", "frame_id"))).alias("frames")
    )
    counts = slim.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_frames"), F.max("timestamp").alias("last_s"))
    return counts.join(listed, "video_id")


def parse_filters(history: DataFrame) -> DataFrame:
    """Add the parsed search request of each history row as ``request``."""
    return history.withColumn("request", F.from_json("filters", SEARCH_REQUEST))


def history_report(history: DataFrame, exact: bool = True) -> DataFrame:
    """Latency count, mean and p95 per search mode."""
    return audit.latency_histogram(history, ["mode"], "latency_ms", exact)


def access_audit(calls: DataFrame, users: DataFrame) -> DataFrame:
    """The code each caller would get for admin, editor and searcher actions."""
    known = users.select(F.col("uid").alias("_uid"), "role", "status")
    joined = calls.join(known, F.col("uid") == F.col("_uid"), "left")
    codes = {
        f"{need}_code": filters.access_label(F.col("_uid"), F.col("role"), F.col("status"), need)
        for need in ("admin", "editor", "searcher")
    }
    return joined.withColumns(codes).drop("_uid", "role", "status")


def upload_audit(uploads: DataFrame, chunks: DataFrame) -> DataFrame:
    """Progress, completeness, conflicts and missing chunks per upload."""
    progress = audit.upload_progress(uploads, chunks)
    conflicts = (
        audit.chunk_conflicts(chunks).groupBy("upload_id").agg(F.count_if(F.col("outcome") == "conflict").alias("conflicts"))
    )
    missing = audit.missing_chunks(uploads, chunks).groupBy("upload_id").agg(F.count(F.lit(1)).alias("missing"))
    return (
        progress.join(conflicts, "upload_id", "left")
        .join(missing, "upload_id", "left")
        .fillna(0, ["conflicts", "missing"])
    )


def job_audit(log: DataFrame, as_of: str, requeue: bool = False, limit: int | None = None) -> DataFrame:
    """Per job: latest status, what a restart makes of it, remaining time, invalid transitions."""
    checked = temporal.validate_transitions(log, ["ts", "event_id"], limit)
    invalid = checked.groupBy("job_id").agg(F.count_if(~F.col("allowed")).alias("invalid_transitions"))
    latest = temporal.latest_per_key(log, ["job_id"], ["ts", "event_id"])
    left = temporal.job_remaining_s(F.col("progress"), F.col("ts"), F.lit(as_of).cast("timestamp"))
    return temporal.reconcile(latest, requeue).withColumn("remaining_s", left).join(invalid, "job_id")
