"""Search modes as one lazy plan each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine_pairs, embed_text, shift_score
from ..operators import context, filters, ranking, retrieval, temporal
from ..schemas import SearchParams
from ..staging import stage

# Field order of a search result.
RESULT_COLUMNS = (
    "video_id", "video_name", "media_type", "timestamp", "timestamp_hms", "similarity", "raw_similarity",
    "frame_id", "retrieval_stage", "frame_url", "stream_url", "duration", "duration_hms", "width", "height",
    "uploaded_at", "context_frames", "context_start", "context_end", "context_start_hms", "context_end_hms",
    "context_reason", "context_text", "context_summary", "final_score", "trace",
)


def query_vectors(queries: DataFrame, dim: int, expand: bool = False) -> DataFrame:
    """``query_id, query`` rows to component vectors with the deterministic backend."""
    guarded = ranking.guard_queries(queries)
    if not expand:
        return embed_text(guarded, "query", dim).withColumn("component", F.lit(0))
    return embed_text(ranking.expand_queries(guarded), "component_text", dim)


def candidates(vectors: DataFrame, queries: DataFrame, media: DataFrame | None, p: SearchParams) -> DataFrame:
    """Top-k frames per query among the media that pass the filters."""
    if media is not None and _filtered(p):
        vectors = filters.restrict_to(vectors, filters.apply_filters(media, p))
    elif p.video_ids or p.media_types or p.media_type:
        vectors = vectors.filter(filters.in_videos(p.video_ids) & filters.media_type_is(p.media_type, p.media_types))
    return retrieval.top_k(
        vectors, queries, p.top_k, min_similarity=p.min_similarity, method=p.fusion_method, boost=p.full_query_boost
    )


def _filtered(p: SearchParams) -> bool:
    return bool(
        p.date_from or p.date_to or p.status or p.min_duration is not None or p.max_duration is not None
    )


def moments(hits: DataFrame, p: SearchParams) -> DataFrame:
    """Events and their representatives; without grouping every hit is its own moment."""
    if p.temporal_grouping:
        return temporal.representatives(temporal.group_events(hits, p.group_window_s), p.max_per_event)
    return hits.withColumn("event_index", F.lit(0)).withColumn("event_hits", F.lit(1).cast("long")).withColumn(
        "event_start", F.col("timestamp")
    ).withColumn("event_end", F.col("timestamp"))


def fine_candidates(events: DataFrame, fine_vectors: DataFrame, queries: DataFrame, p: SearchParams) -> DataFrame:
    """Score finer frames inside the visited events; only the bounded events' frames are touched.

    ``queries`` holds the full-query vectors (component 0).
    """
    span = events.withColumn("span_s", F.lit(2 * p.context_window_s)).withColumn("n_frames", F.col("event_hits"))
    visited = ranking.bound_events(span, p.fine_max_events, p.fine_max_seconds, p.fine_max_frames)
    wanted = visited.select("query_id", "video_id", "event_index", "timestamp", F.col("frame_id").alias("coarse_frame"))
    near = temporal.frames_near(wanted, fine_vectors, p.context_window_s)
    full = queries.filter(F.col("component") == 0).select("query_id", F.col("embedding").alias("_q"))
    scored = near.join(full, "query_id").withColumn("raw_similarity", cosine_pairs("near_embedding", "_q"))
    return scored.select(
        "query_id", "video_id", "event_index",
        F.col("near_frame_id").alias("frame_id"), F.col("near_timestamp").alias("timestamp"),
        "raw_similarity", F.round(shift_score(F.col("raw_similarity")), 12).alias("score"),
    )


def project_results(ranked: DataFrame, media: DataFrame, frames: DataFrame, p: SearchParams, stamps: dict[str, str]) -> DataFrame:
    """Join media facts, add context, text and trace; one row per result."""
    facts = media.select(
        "video_id", F.col("filename").alias("video_name"), F.col("duration_seconds").alias("duration"),
        "width", "height", "uploaded_at",
    )
    # A frame whose media row is missing stays a result; its name falls back to the id.
    joined = ranked.join(facts, "video_id", "left").withColumn("video_name", F.coalesce("video_name", "video_id"))
    traced = ranking.with_trace(joined, stamps)
    described = context.with_text(
        context.with_context(traced, frames, p.context_window_s, p.context_bins, p.context_segment)
    )
    return described.withColumn("frame_url", context.frame_url(F.col("video_id"), F.col("frame_id"))).withColumn(
        "stream_url", F.concat(F.lit("media/"), F.col("video_id"))
    ).select("query_id", "query", "rank", *RESULT_COLUMNS)


def search_moments(
    vectors: DataFrame,
    queries: DataFrame,
    media: DataFrame,
    p: SearchParams = SearchParams(),
    mode: str = "accurate",
    *,
    dim: int = 64,
    fine_vectors: DataFrame | None = None,
    permutation: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    stamps: dict[str, str] | None = None,
) -> DataFrame:
    """``queries`` (query_id, query) to ranked results with the 26 result fields.

    ``fast``: retrieval and grouping. ``accurate``: expansion, fine search where
    ``fine_vectors`` are given, deterministic rerank, and an external
    ``permutation`` where valid, which takes the place of relevance in sorting. It is a
    table (query_id, frame_id, new_rank) or a function that makes one from the ranked
    shortlist, as an external reranker does; ``trace`` says what became of it.
    ``stamps`` name the model the queries were embedded with. Vectors of another one, and
    vectors that do not say, are refused; ``allow_model_mismatch`` leaves foreign vectors out
    and lets unstamped ones pass. ``metadata`` mode is :func:`search_metadata`.
    """
    accurate = mode == "accurate"
    vectors = ranking.gate(vectors, stamps, p.allow_model_mismatch)
    if fine_vectors is not None:
        fine_vectors = ranking.gate(fine_vectors, stamps, p.allow_model_mismatch)
    comps = query_vectors(queries, dim, expand=accurate)
    found = moments(candidates(vectors, comps, media, p), p).withColumn("retrieval_stage", F.lit("coarse"))
    if accurate and p.fine_search and fine_vectors is not None:
        # Read twice below; staged so that the vectors are scanned once.
        found = stage(found, "events")
        found = ranking.merge_fine(found, fine_candidates(found, fine_vectors, comps, p))
        found = ranking.one_per_frame(found)
    found = ranking.normalize(found, p.normalization)
    if accurate:
        found = ranking.rerank(found, p.rerank)
    else:
        found = found.withColumn("final_score", F.col("score"))
    if permutation is not None:
        # Ranks without gaps first, so that an unused permutation leaves the plain order.
        found = ranking.order_results(found.drop("rank"))
        if callable(permutation):
            # Read by the reranker and by the join with its answer.
            found = stage(found, "shortlist")
            permutation = permutation(found)
        found = ranking.accept_permutation(found, permutation).drop("rank")
    if p.sort_by == "upload_date":
        # A moment whose media row is missing has no date and comes last.
        found = found.join(media.select("video_id", "uploaded_at"), "video_id", "left")
    ranked = ranking.order_results(found, p.sort_by, p.sort_order, p.final_results)
    ranked = ranked.drop("uploaded_at") if "uploaded_at" in ranked.columns else ranked
    named = ranked.join(ranking.guard_queries(queries).select("query_id", "query"), "query_id")
    frames = vectors
    if accurate and p.fine_search and fine_vectors is not None:
        # A fine match is shown among fine frames; coarse ones fill in where there are none.
        # A frame in both counts once: frames near a moment are aggregated by their place.
        columns = ["frame_id", "video_id", "timestamp"]
        frames = vectors.select(*columns).unionByName(fine_vectors.select(*columns))
    return project_results(named, media, frames, p, stamps or {})


def search_metadata(media: DataFrame, text: str, p: SearchParams = SearchParams()) -> DataFrame:
    """Library items whose metadata contain every query word; vectors are not read."""
    columns = tuple(c for c in filters.METADATA_COLUMNS if c in media.columns)
    return filters.apply_filters(media, p).filter(filters.metadata_match(text, columns))


def response_counts(hits: DataFrame, events: DataFrame) -> DataFrame:
    """Total candidates and grouped events per search."""
    totals = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_candidates"))
    grouped = events.groupBy("query_id").agg(
        F.countDistinct("video_id", "event_index").alias("grouped_events")
    )
    return totals.join(grouped, "query_id", "left").fillna(0, ["grouped_events"])
