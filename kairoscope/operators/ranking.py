"""Query expansion, fusion, normalisation, reranking and result ordering.

All windows here run over retrieved candidates: at most ``top_k`` rows per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import shift_score
from ..schemas import STAMP_COLUMNS, RerankWeights

# Blanks around a query, and connector words that split one.
BLANKS = " \t\r\n\f\v"
CONNECTORS = ("next to", "in front of", "near", "with", "and", "beside", "behind", "under")


def guard_queries(queries: DataFrame, text: str = "query") -> DataFrame:
    """Drop blank queries and trim the rest."""
    return queries.withColumn(text, F.btrim(F.col(text), F.lit(BLANKS))).filter(F.col(text) != "")


def expand_queries(queries: DataFrame, text: str = "query", connectors: tuple[str, ...] = CONNECTORS) -> DataFrame:
    """One row per component; component 0 is the full query."""
    pattern = r"(?i)[ \t\r\n]+(?:" + "|".join(connectors) + r")[ \t\r\n]+"
    parts = F.filter(F.transform(F.split(text, pattern), lambda p: F.trim(p)), lambda p: p != "")
    all_parts = F.when(F.size(parts) > 1, F.concat(F.array(F.col(text)), parts)).otherwise(F.array(F.col(text)))
    return queries.select("*", F.posexplode(all_parts).alias("component", "component_text"))


def fuse(scores: DataFrame, method: str = "max", boost: float = 1.2) -> DataFrame:
    """Fuse per-component ``similarity`` rows into one score per (query, frame)."""
    n = F.count(F.lit(1)).alias("_n")
    full = F.max(F.when(F.col("component") == 0, F.col("similarity"))).alias("_full")
    rest = F.col("similarity")
    others = (F.max if method == "max" else F.sum)(F.when(F.col("component") > 0, rest)).alias("_others")
    several = F.max("n_components").alias("_components")
    grouped = scores.groupBy("query_id", "frame_id").agg(n, full, others, several)
    boosted = F.when(F.col("_components") > 1, F.col("_full") * boost).otherwise(F.col("_full"))
    if method == "max":
        score = F.greatest(boosted, "_others")
    else:
        score = F.coalesce(boosted, F.lit(0.0)) + F.coalesce(F.col("_others"), F.lit(0.0))
    return grouped.select("query_id", "frame_id", score.alias("score"))


def normalize(hits: DataFrame, method: str = "shift", score: str = "score") -> DataFrame:
    """Add ``similarity``: ``none`` | ``minmax`` per query | ``shift`` of the raw cosine."""
    if method == "none":
        return hits.withColumn("similarity", F.col(score))
    if method == "shift":
        return hits.withColumn("similarity", shift_score(F.col("raw_similarity")))
    if method != "minmax":
        raise ValueError(f"unknown normalisation {method!r}")
    w = Window.partitionBy("query_id")
    low, high = F.min(score).over(w), F.max(score).over(w)
    return hits.withColumn(
        "similarity", F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(F.lit(1.0))
    )


def _micros(seconds: float) -> tuple[int, int]:
    """A symmetric range in microseconds; whole numbers keep the bounds exact."""
    return -round(seconds * 1e6), round(seconds * 1e6)


def rerank(hits: DataFrame, weights: RerankWeights | None = None) -> DataFrame:
    """Weighted, deterministic score over candidates; adds ``final_score`` and ``rank``."""
    weights = weights or RerankWeights()
    in_video = Window.partitionBy("query_id", "video_id")
    by_score = in_video.orderBy(F.desc("similarity"), F.asc("timestamp"), F.asc("frame_id"))
    in_time = in_video.orderBy("_micros")
    near = in_time.rangeBetween(*_micros(weights.neighbour_window_s))
    close = in_time.rangeBetween(*_micros(weights.duplicate_window_s))
    scored = (
        hits.withColumn("_micros", F.round(F.col("timestamp") * 1e6).cast("long"))
        .withColumn("row_in_video", F.row_number().over(by_score))
        .withColumn("neighbours", F.count(F.lit(1)).over(near) - 1)
        .withColumn("best_nearby", F.max("similarity").over(close))
    )
    neighbour = F.col("neighbours") / (F.col("neighbours") + 1.0)
    duplicate = (F.col("best_nearby") > F.col("similarity")).cast("double")
    final = (
        weights.semantic * F.col("similarity")
        + weights.full_query * (F.col("matched_component") == 0).cast("double")
        + weights.neighbour * neighbour
        + weights.diversity / F.col("row_in_video")
        - weights.duplicate * duplicate
    )
    scored = scored.withColumn("final_score", F.round(final, 12)).drop("best_nearby", "_micros")
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), F.asc("frame_id"))
    return scored.withColumn("rank", F.row_number().over(order))


def accept_permutation(hits: DataFrame, supplied: DataFrame) -> DataFrame:
    """Use an external ranking where it is a permutation of the candidates.

    ``supplied``: ``query_id, frame_id, new_rank``. Adds ``final_rank`` and
    ``rerank`` (applied | skipped | unavailable). Invalid rankings keep the vector order.
    """
    offered = supplied.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.countDistinct("frame_id").alias("_frames"),
        F.countDistinct("new_rank").alias("_ranks"),
        F.min("new_rank").alias("_low"),
        F.max("new_rank").alias("_high"),
    )
    one_each = supplied.groupBy("query_id", "frame_id").agg(F.min("new_rank").alias("new_rank"))
    w = Window.partitionBy("query_id")
    joined = hits.join(one_each, ["query_id", "frame_id"], "left").join(offered, "query_id", "left")
    n = F.count(F.lit(1)).over(w)
    matched = F.count("new_rank").over(w)
    valid = (
        (matched == n) & (F.col("_rows") == n) & (F.col("_frames") == n) & (F.col("_ranks") == n)
        & (F.col("_low") == 1) & (F.col("_high") == n)
    )
    status = F.when(F.col("_rows").isNull(), "unavailable").when(valid, "applied").otherwise("skipped")
    return (
        joined.withColumn("rerank", status)
        .withColumn("final_rank", F.when(F.col("rerank") == "applied", F.col("new_rank")).otherwise(F.col("rank")))
        .drop("new_rank", "_rows", "_frames", "_ranks", "_low", "_high")
    )


def merge_fine(coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """Take a fine candidate only where it scores higher than the coarse one.

    Both are keyed by ``query_id, video_id, event_index``; ``fine`` carries its
    best candidate per key. Adds ``retrieval_stage``.
    """
    keys = ["query_id", "video_id", "event_index"]
    moved = [c for c in ("frame_id", "timestamp", "raw_similarity", "score") if c in coarse.columns]
    best = fine.groupBy(*keys).agg(
        F.min_by(F.struct(*moved), F.struct(-F.col("score"), "timestamp", "frame_id")).alias("_fine")
    )
    better = F.coalesce(F.col("_fine")["score"] > F.col("score"), F.lit(False))
    joined = coarse.join(best, keys, "left").withColumn("_better", better)
    picked = [F.when(F.col("_better"), F.col("_fine")[c]).otherwise(F.col(c)).alias(c) for c in moved]
    rest = [c for c in coarse.columns if c not in moved and c != "retrieval_stage"]
    stage = F.when(F.col("_better"), "fine").otherwise("coarse").alias("retrieval_stage")
    return joined.select(*rest, *picked, stage)


def one_per_frame(moments: DataFrame) -> DataFrame:
    """Where a fine search moved several moments to one frame, the earlier event, then the better rank, keeps it."""
    w = Window.partitionBy("query_id", "frame_id").orderBy("event_index", "rank")
    return moments.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def bound_events(events: DataFrame, max_events: int, max_seconds: float, max_frames: int) -> DataFrame:
    """Events a fine search may visit: best first until any budget is used up.

    Needs ``query_id, score, frame_id, span_s, n_frames``.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("frame_id"))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return (
        events.withColumn("event_rank", F.row_number().over(w))
        .withColumn("seconds_used", F.sum("span_s").over(running))
        .withColumn("frames_used", F.sum("n_frames").over(running))
        .filter(
            (F.col("event_rank") <= max_events)
            & (F.col("seconds_used") <= max_seconds)
            & (F.col("frames_used") <= max_frames)
        )
    )


def with_trace(hits: DataFrame, stamps: dict[str, str]) -> DataFrame:
    """Add the ``trace`` map from measured columns and the index's stamps."""
    pairs: list[Column] = []
    for key, column in (
        ("retrieval_stage", F.col("retrieval_stage")),
        ("frame_id", F.col("frame_id")),
        ("score", F.format_string("%.6f", F.col("score"))),
        ("raw_cosine", F.format_string("%.6f", F.col("raw_similarity"))),
        ("group_event_index", F.col("event_index").cast("string")),
    ):
        pairs += [F.lit(key), column]
    if "rerank" in hits.columns:  # what became of an external permutation
        pairs += [F.lit("rerank"), F.col("rerank")]
    for key, value in stamps.items():
        pairs += [F.lit(key), F.lit(value)]
    return hits.withColumn("trace", F.create_map(*pairs))


def order_results(
    results: DataFrame, sort_by: str = "relevance", sort_order: str = "desc", final_results: int | None = None
) -> DataFrame:
    """Rank results per query and keep the first ``final_results``."""
    column = {"relevance": "final_score", "timestamp": "timestamp", "upload_date": "uploaded_at"}[sort_by]
    first = F.desc_nulls_last(column) if sort_order == "desc" else F.asc_nulls_last(column)
    if sort_by == "relevance" and "final_rank" in results.columns:  # an accepted permutation: rank 1 is best
        first = F.asc("final_rank") if sort_order == "desc" else F.desc("final_rank")
    w = Window.partitionBy("query_id").orderBy(first, F.asc("frame_id"))
    ranked = results.withColumn("rank", F.row_number().over(w))
    return ranked if final_results is None else ranked.filter(F.col("rank") <= final_results)


# --- model compatibility -------------------------------------------------------------


def stamp_report(vectors: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Distinct stamps of an index with row counts and a match flag."""
    groups = vectors.groupBy(*STAMP_COLUMNS).agg(F.count(F.lit(1)).alias("n_vectors"))
    same = F.lit(True)
    for name in STAMP_COLUMNS:
        same = same & F.col(name).cast("string").eqNullSafe(F.lit(str(expected[name])))
    return groups.withColumn("compatible", same)


def require_compatible(vectors: DataFrame, expected: dict[str, str], allow_mismatch: bool = False) -> DataFrame:
    """Fail closed on foreign vectors, or leave them out when explicitly allowed."""
    same = F.lit(True)
    for name in STAMP_COLUMNS:
        same = same & F.col(name).cast("string").eqNullSafe(F.lit(str(expected[name])))
    if allow_mismatch:
        return vectors.filter(same)
    if not vectors.filter(~same).isEmpty():
        raise ValueError("the index holds vectors of another model, revision, dimension or version")
    return vectors


def gate(vectors: DataFrame, expected: dict[str, str] | None, allow_mismatch: bool = False) -> DataFrame:
    """The vectors if they are known to come from the expected model.

    Fails closed: without stamps on the vectors, or without an expectation for each of
    them, nothing is known. ``allow_mismatch`` lets unstamped vectors pass.
    """
    unstamped = [c for c in STAMP_COLUMNS if c not in vectors.columns]
    unexpected = [c for c in STAMP_COLUMNS if c not in (expected or {})]
    if unstamped or unexpected:
        if allow_mismatch:
            return vectors
        raise ValueError(f"the model of the vectors is not known: stamps missing {unstamped}, not expected {unexpected}")
    return require_compatible(vectors, expected, allow_mismatch)
