"""Counts, consistency checks and roll-ups over the metadata tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .ordered import ordered_groups
from .skew import attach_group_values


# --- uploads -----------------------------------------------------------------------


def chunk_conflicts(chunks: DataFrame) -> DataFrame:
    """Per (upload, index): number of writes and whether they conflict.

    Contents differ iff the smallest and largest hash differ, which aggregates
    in one partial pass where a distinct count would need two.
    """
    grouped = chunks.groupBy("upload_id", "idx").agg(
        F.count(F.lit(1)).alias("writes"), (F.min("sha256") != F.max("sha256")).alias("differ")
    )
    outcome = F.when(F.col("differ"), "conflict").when(F.col("writes") > 1, "replayed").otherwise("single")
    return grouped.withColumn("outcome", outcome).drop("differ")


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """One row per (upload, index): the first write wins, later ones are replays or conflicts."""
    first = F.min_by("size", F.struct("received_at", "sha256", "size")).alias("size")
    return chunks.groupBy("upload_id", "idx").agg(first)


def upload_progress(uploads: DataFrame, chunks: DataFrame) -> DataFrame:
    """Received chunks and bytes, percent and completeness per upload."""
    received = distinct_chunks(chunks).groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("received_chunks"), F.sum("size").alias("received_bytes")
    )
    joined = uploads.join(received, "upload_id", "left").fillna(0, ["received_chunks", "received_bytes"])
    percent = F.when(F.col("total_chunks") == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(100.0), F.col("received_chunks") / F.col("total_chunks") * 100)
    )
    return (
        joined.withColumn("progress", percent)
        .withColumn("chunks_ok", F.col("received_chunks") == F.col("total_chunks"))
        .withColumn("bytes_ok", F.col("received_bytes") == F.col("file_size"))
    )


def missing_chunks(uploads: DataFrame, chunks: DataFrame) -> DataFrame:
    """Expected chunk indexes that were never received."""
    wanted = uploads.filter(F.col("total_chunks") > 0).select(
        "upload_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_chunks").cast("long") - 1)).alias("idx")
    )
    return wanted.join(chunks.select("upload_id", F.col("idx").cast("long").alias("idx")), ["upload_id", "idx"], "left_anti")


def completion_violations(completions: DataFrame) -> DataFrame:
    """Uploads whose repeated completion made more than one video or job."""
    several = lambda c: F.min(c) != F.max(c)  # noqa: E731 - one partial pass, unlike a distinct count
    return (
        completions.groupBy("upload_id")
        .agg(
            F.count(F.lit(1)).alias("completions"),
            several("video_id").alias("several_videos"),
            several("job_id").alias("several_jobs"),
        )
        .filter(F.col("several_videos") | F.col("several_jobs"))
    )


# --- consistency -------------------------------------------------------------------


def missing_from(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` without a row in ``right``."""
    return left.select(key).join(right.select(key), key, "left_anti")


def reconcile_keys(sides: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per key with a presence flag per table and whether all agree.

    Each side is reduced to its distinct keys before the join, so no key fans out.
    """
    tagged = [
        df.select(F.col(key).alias("key")).distinct().withColumn(f"in_{name}", F.lit(True)) for name, df in sides.items()
    ]
    joined = reduce(lambda a, b: a.join(b, "key", "full_outer"), tagged).fillna(False)
    flags = [F.col(f"in_{name}") for name in sides]
    return joined.withColumn("reconciliation_required", ~reduce(lambda a, b: a & b, flags))


def consistency_report(checks: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """Tidy (check, n): for each name, rows of the first table missing from the second."""
    parts = [
        missing_from(left, right, key).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
        for name, (left, right, key) in checks.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def model_consistency(vectors: DataFrame, registry_model: str) -> DataFrame:
    """Each model of the index with its row count, and whether it is the only, registered one."""
    per_model = vectors.groupBy("model").agg(F.count(F.lit(1)).alias("n_vectors"))
    only = per_model.agg((F.count(F.lit(1)) == 1).alias("x")).scalar()
    registered = per_model.agg((F.max("model") == registry_model).alias("x")).scalar()
    return per_model.withColumn("consistent", only & registered)


# --- metrics -----------------------------------------------------------------------


def exact_percentile(
    df: DataFrame, keys: list[str], value: str, q: float, name: str, limit: int | None = None
) -> DataFrame:
    """Linear-interpolated percentile per key without gathering a key's values.

    Equal values are counted first; running counts over the ordered values then
    locate the two ranks around ``q * (n - 1)``.
    """
    seen = df.filter(F.col(value).isNotNull())
    counts = seen.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = ordered_groups(counts, keys, ["_v"], limit).running_sum("_upto", "_c").result()
    totals = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    at = (F.col("_total") - 1) * F.lit(q)
    both = attach_group_values(ranked, totals, keys, "_total", "_v", limit)
    holds = lambda rank: (F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank)
    low, high = F.floor(at), F.ceil(at)
    return (
        both.filter(holds(low) | holds(high))
        .groupBy(*keys)
        .agg(
            F.max(F.when(holds(low), F.col("_v"))).alias("_low"),
            F.max(F.when(holds(high), F.col("_v"))).alias("_high"),
            F.max(at - low).alias("_frac"),
        )
        .select(*keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_frac")).alias(name))
    )


def latency_histogram(
    df: DataFrame, keys: list[str], value: str, exact: bool = True, limit: int | None = None
) -> DataFrame:
    """Count, mean and p95 per metric; ``exact=False`` uses one pass with a bounded sketch."""
    base = [F.count(value).alias("count"), F.avg(value).alias("mean")]
    if not exact:
        return df.groupBy(*keys).agg(*base, F.approx_percentile(value, 0.95, 10_000).alias("p95"))
    return df.groupBy(*keys).agg(*base).join(exact_percentile(df, keys, value, 0.95, "p95", limit), keys)


def latency_sketches(
    df: DataFrame, keys: list[str], ts: str, value: str, window: str = "1 hour", k: int = 800
) -> DataFrame:
    """Count, total and quantile sketch per key and time window, in one scan.

    Rows are small however many values a window has, so they can be stored and merged
    later; with ``k`` = 800 a quantile's rank is off by less than half a percent, as a rule.
    """
    seen = df.filter(F.col(value).isNotNull() & F.col(ts).isNotNull())
    return (
        seen.groupBy(*keys, F.window(ts, window)["start"].alias("window_start"))
        .agg(
            F.count(F.lit(1)).alias("count"), F.sum(value).alias("total"),
            F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"),
        )
    )


def merged_latency(sketches: DataFrame, keys: list[str], q: float = 0.95, name: str = "p95") -> DataFrame:
    """Count, mean and quantile per key from any set of window sketches."""
    merged = sketches.groupBy(*keys).agg(
        F.sum("count").alias("count"), (F.sum("total") / F.sum("count")).alias("mean"),
        F.kll_merge_agg_double("sketch").alias("_sketch"),
    )
    quantile = F.kll_sketch_get_quantile_double(F.col("_sketch"), F.lit(q))
    return merged.select(*keys, "count", "mean", quantile.alias(name))


def counters(samples: DataFrame) -> DataFrame:
    """Counter totals per name."""
    return samples.groupBy("name").agg(F.sum("value").alias("total"))


def gauges(samples: DataFrame, order: list[str]) -> DataFrame:
    """Latest value per name."""
    return samples.groupBy("name").agg(F.max_by("value", F.struct(*order)).alias("value"))


def storage_usage(media: DataFrame) -> DataFrame:
    usage = media.groupBy("media_type").agg(
        F.count(F.lit(1)).alias("items"), F.sum("size_bytes").alias("total_bytes")
    )
    return usage.withColumn("total_text", X.format_bytes(F.col("total_bytes")))


def health(status: DataFrame, by: list[str]) -> DataFrame:
    """``healthy`` iff every component reports ok."""
    return status.groupBy(*by).agg(
        F.when(F.every(F.coalesce(F.col("status") == "ok", F.lit(False))), "healthy").otherwise("degraded").alias("health"),
        F.count(F.lit(1)).alias("components"),
    )


def with_embedded(frames: DataFrame, index: DataFrame, key: str = "frame_id") -> DataFrame:
    """``frames`` with ``embedded``: whether the index holds the frame."""
    held = index.select(key).distinct().withColumn("embedded", F.lit(True))
    return frames.drop("embedded").join(held, key, "left").withColumn("embedded", F.coalesce("embedded", F.lit(False)))


def frame_counters(frames: DataFrame) -> DataFrame:
    """Sampled, kept and embedded frames per item and the share removed as duplicates."""
    counted = frames.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("frames_sampled"),
        F.count_if("kept").alias("frames_kept"),
        F.count_if(F.col("kept") & F.col("embedded")).alias("frames_embedded"),
    )
    return counted.withColumn("dedup_ratio", 1 - F.col("frames_kept") / F.col("frames_sampled"))


def feedback_summary(feedback: DataFrame, by: list[str]) -> DataFrame:
    return feedback.groupBy(*by).agg(
        F.count(F.lit(1)).alias("votes"),
        F.count_if("relevant").alias("thumbs_up"),
        F.avg(F.col("relevant").cast("double")).alias("approval"),
    )


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Offset page; Spark turns it into a bounded top-k."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def keyset_page(df: DataFrame, sort: str, key: str, last: tuple | None, size: int, descending: bool = True) -> DataFrame:
    """Rows after ``last = (sort value, key)``; the bound is a pushable filter.

    Rows without a sort value come last in either direction, in key order.
    """
    order = [F.desc_nulls_last(sort), F.desc(key)] if descending else [F.asc_nulls_last(sort), F.asc(key)]
    if last is not None:
        value, k = F.lit(last[0]), F.lit(last[1])
        later = F.col(key) < k if descending else F.col(key) > k
        if last[0] is None:
            df = df.filter(F.col(sort).isNull() & later)
        elif descending:
            df = df.filter(F.col(sort).isNull() | (F.col(sort) < value) | ((F.col(sort) == value) & later))
        else:
            df = df.filter(F.col(sort).isNull() | (F.col(sort) > value) | ((F.col(sort) == value) & later))
    return df.orderBy(*order).limit(size)
