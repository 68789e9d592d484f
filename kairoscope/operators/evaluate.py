"""Retrieval evaluation against a golden set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judge(ranked: DataFrame, golden: DataFrame, tolerance_s: float) -> DataFrame:
    """Add ``right_video`` and ``hit`` (right video, time within the expected interval +- tolerance)."""
    joined = ranked.join(golden, "query_id")
    right = F.col("video_id") == F.col("expected_video_id")
    inside = F.col("timestamp").between(
        F.col("expected_start") - tolerance_s, F.col("expected_end") + tolerance_s
    )
    return joined.withColumn("right_video", right).withColumn("hit", right & inside)


def evaluate(
    ranked: DataFrame, golden: DataFrame, ks: tuple[int, ...] = (1, 5, 10), tolerance_s: float = 0.0
) -> DataFrame:
    """Recall@k, MRR, video recall and temporal accuracy as one row.

    Golden queries without any result count as misses.
    """
    judged = judge(ranked, golden, tolerance_s)
    per_query = judged.groupBy("query_id").agg(
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("hit_rank"),
        F.min(F.when(F.col("right_video"), F.col("rank"))).alias("video_rank"),
        F.min_by(F.col("hit"), F.when(F.col("right_video"), F.col("rank"))).alias("top_right_hit"),
    )
    every = golden.select("query_id").join(per_query, "query_id", "left")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return every.agg(
        F.count(F.lit(1)).alias("queries"),
        *[share(F.col("hit_rank") <= k).alias(f"recall_at_{k}") for k in ks],
        F.avg(F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0))).alias("mrr"),
        share(F.col("video_rank") <= max(ks)).alias("video_recall"),
        F.coalesce(F.avg(F.col("top_right_hit").cast("double")), F.lit(0.0)).alias("temporal_accuracy"),
    )
