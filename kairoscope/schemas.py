"""Record types and search parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


S, L, D, I, B, TS = (
    T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.TimestampType(),
)

MEDIA = _struct(
    video_id=S, filename=S, stored_filename=S, media_type=S, size_bytes=L, duration_seconds=D,
    fps=D, width=I, height=I, codec=S, container=S, has_audio=B, status=S, frame_count=L,
    error=S, uploaded_at=TS, indexed_at=TS,
)
FRAMES = _struct(frame_id=S, video_id=S, timestamp=D, frame_path=S, phash=L)
VECTORS = _struct(
    frame_id=S, video_id=S, media_type=S, timestamp=D, embedding=T.ArrayType(T.FloatType()),
    model=S, model_revision=S, dim=I, preprocessing_version=S, indexing_version=S,
)
JOBS = _struct(
    job_id=S, video_id=S, type=S, status=S, progress=D, current_stage=S, frames_processed=L,
    frames_total=L, frames_sampled=L, frames_kept=L, frames_embedded=L, error=S,
    created_at=TS, updated_at=TS,
)
UPLOADS = _struct(
    upload_id=S, filename=S, file_size=L, content_type=S, chunk_size=L, total_chunks=L,
    status=S, error=S,
)
UPLOAD_CHUNKS = _struct(upload_id=S, idx=I, size=L, sha256=S, received_at=TS)
CONTEXT_FRAME = _struct(frame_id=S, timestamp=D, timestamp_hms=S, frame_url=S)
SAVED_CONTEXTS = _struct(
    id=L, query=S, video_id=S, filename=S, media_type=S, timestamp_seconds=D, timestamp_hms=S,
    context_start=D, context_end=D, score=D, frame_id=S, context_text=S,
    context_frames=T.ArrayType(CONTEXT_FRAME), reason=S, created_at=TS,
)
HISTORY = _struct(id=L, query=S, filters=S, result_count=L, mode=S, latency_ms=D, created_at=TS)
FEEDBACK = _struct(query=S, relevant=B, video_id=S, frame_id=S, timestamp=D)
FINE_CACHE = _struct(
    video_id=S, start=D, end=D, interval=D, extraction_version=S, preprocessing_version=S, complete=B,
)
USERS = _struct(uid=S, email=S, role=S, status=S)
GOLDEN = _struct(query_id=S, query=S, expected_video_id=S, expected_start=D, expected_end=D)
SEARCH_REQUEST = _struct(
    query=S, mode=S, video_ids=T.ArrayType(S), date_from=S, date_to=S, min_similarity=D, top_k=I,
    final_results=I, fine_search=B, temporal_grouping=B, sort_by=S, sort_order=S,
    media_types=T.ArrayType(S), min_duration=D, max_duration=D, status=S, media_type=S,
)

# Enumerations of the record types.
VIDEO_STATUS = (
    "pending", "queued", "validating", "probing", "extracting_frames", "deduplicating",
    "embedding", "indexing", "finalizing", "ready", "failed", "cancelled",
)
JOB_STATUS = ("queued", "running", "completed", "failed", "cancelled", "cancelling")
SEARCH_MODES = ("fast", "accurate", "metadata")
STAMP_COLUMNS = ("dim", "model", "model_revision", "preprocessing_version", "indexing_version")


@dataclass(frozen=True)
class SearchParams:
    """Request fields with the client's defaults, then engine settings."""

    video_ids: tuple[str, ...] = ()
    date_from: str = ""
    date_to: str = ""
    min_similarity: float = 0.0
    top_k: int = 50
    final_results: int = 5
    fine_search: bool = True
    temporal_grouping: bool = True
    sort_by: str = "relevance"
    sort_order: str = "desc"
    media_types: tuple[str, ...] = ()
    min_duration: float | None = None
    max_duration: float | None = None
    status: str = ""
    media_type: str = ""

    group_window_s: float = 10.0
    max_per_event: int = 1
    normalization: str = "shift"
    fusion_method: str = "max"
    full_query_boost: float = 1.2
    context_window_s: float = 8.0
    context_bins: int = 5
    context_segment: str = "evidence"
    fine_max_events: int = 10
    fine_max_seconds: float = 160.0
    fine_max_frames: int = 500
    allow_model_mismatch: bool = False
    rerank: "RerankWeights" = field(default_factory=lambda: RerankWeights())


@dataclass(frozen=True)
class RerankWeights:
    semantic: float = 1.0
    full_query: float = 0.05
    neighbour: float = 0.0
    diversity: float = 0.05
    duplicate: float = 0.0
    neighbour_window_s: float = 10.0
    duplicate_window_s: float = 1.0
