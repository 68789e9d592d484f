"""The given tables in the shape of the engine's record types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoscope.sources.tables import read_table

DIM = 64
STAMPS = {
    "dim": "64", "model": "given-vectors", "model_revision": "r1",
    "preprocessing_version": "p1", "indexing_version": "i1",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def video_id() -> Column:
    image = F.concat(F.lit("img_"), F.col("vec_id").cast("string"))
    return F.when(F.col("label") == 9, image).otherwise(F.concat(F.lit("clip_"), F.col("label").cast("string")))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Clips 0-8 are videos with a frame about every two seconds; label 9 are single images."""
    image = F.col("label") == 9
    return table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("frame_id"),
        video_id().alias("video_id"),
        F.when(image, "image").otherwise("video").alias("media_type"),
        F.when(image, F.lit(0.0)).otherwise(F.col("vec_id").cast("double") / 5).alias("timestamp"),
        "embedding",
    )


def stamped(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with model stamps; images carry an older indexing version."""
    return vectors(spark, d).select(
        "*",
        F.size("embedding").alias("dim"),
        F.lit(STAMPS["model"]).alias("model"),
        F.lit(STAMPS["model_revision"]).alias("model_revision"),
        F.lit(STAMPS["preprocessing_version"]).alias("preprocessing_version"),
        F.when(F.col("media_type") == "image", "i0").otherwise(STAMPS["indexing_version"]).alias("indexing_version"),
    )


def media(spark: SparkSession, d: str) -> DataFrame:
    grouped = vectors(spark, d).groupBy("video_id", "media_type").agg(
        F.count(F.lit(1)).alias("frame_count"),
        F.max("timestamp").alias("_last"),
        F.min(F.col("frame_id").cast("long")).alias("_first"),
    )
    video = F.col("media_type") == "video"
    day = F.pmod(F.col("_first"), F.lit(30)) * 86400
    return grouped.select(
        "video_id",
        F.concat(F.col("video_id"), F.when(video, ".mp4").otherwise(".png")).alias("filename"),
        "media_type",
        "frame_count",
        F.when(video, F.col("_last")).alias("duration_seconds"),
        F.lit(640).alias("width"),
        F.lit(360).alias("height"),
        F.timestamp_seconds(F.lit(1704067200) + day).alias("uploaded_at"),
        F.lit("ready").alias("status"),
        F.when(video, "h264").otherwise("png").alias("codec"),
        F.when(video, "mp4").otherwise("png").alias("container"),
    )


def text_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))


def library(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("video_id"),
        F.concat_ws("", F.lower("o_orderpriority"), F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".mp4")).alias("filename"),
        F.col("o_totalprice").alias("size_bytes"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderstatus") == "P", "image").otherwise("video").alias("media_type"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 100).alias("duration_seconds"),
        F.col("o_orderdate").alias("uploaded_at"),
    )


def history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("mode"), F.col("value").alias("latency_ms"),
        F.col("props").alias("filters"), F.col("ts").alias("created_at"),
    )


def job_log(spark: SparkSession, d: str) -> DataFrame:
    return as_job_log(table(spark, d, "events"))


def as_job_log(events: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("event_type") == "signup", "queued")
        .when(F.col("event_type") == "view", "running")
        .when(F.col("event_type") == "purchase", "completed")
        .when(F.col("event_type") == "error", "failed")
        .otherwise("cancelling")
    )
    return events.select(
        F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), "value"
    )


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("upload_id"),
        (F.col("l_linenumber") - 1).alias("idx"),
        F.sha2(F.col("l_quantity").cast("int").cast("string"), 256).alias("sha256"),
        F.col("l_quantity").cast("long").alias("size"),
        F.col("l_shipdate").alias("received_at"),
    )


def uploads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("upload_id"),
        F.floor(F.col("o_totalprice") / 1000).alias("file_size"),
        (F.pmod(F.col("o_custkey"), F.lit(8))).alias("total_chunks"),
    )


def cache(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    start = seconds(F.col("ts"))
    return e.select(
        F.col("user_id").alias("video_id"), start.alias("start"), (start + F.col("value") * 60).alias("end"),
        F.when(F.col("event_type") == "error", 2.0).otherwise(1.0).alias("interval"),
        F.lit("x1").alias("extraction_version"), F.lit("p1").alias("preprocessing_version"),
        (F.col("event_type") != "signup").alias("complete"),
    )


def hashes(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic 8-bit hashes, in frame order within a clip."""
    return table(spark, d, "embeddings").select(
        F.col("label").alias("video_id"), F.col("vec_id").alias("frame_id"),
        F.pmod(F.col("vec_id") * F.col("vec_id"), F.lit(256)).cast("long").alias("phash"),
    )


def sign_hashes(spark: SparkSession, d: str, bits: int = 24) -> DataFrame:
    """A perceptual hash of each frame: the signs of the first values of its embedding."""
    one = F.lit(1).cast("long")
    signs = [F.when(F.col("embedding")[i] > 0, F.shiftleft(one, i)).otherwise(F.lit(0).cast("long")) for i in range(bits)]
    phash = signs[0]
    for sign in signs[1:]:
        phash = phash.bitwiseOR(sign)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("frame_id"), phash.alias("phash"))


def users(spark: SparkSession, d: str) -> DataFrame:
    role = (
        F.when(F.col("c_mktsegment") == "MACHINERY", "ADMIN")
        .when(F.col("c_mktsegment") == "BUILDING", "VIDEO_EDITOR")
        .otherwise("SEARCHER")
    )
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("uid"),
        F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
        role.alias("role"),
        F.when(F.col("c_acctbal") < 0, "REVOKED").otherwise("ACTIVE").alias("status"),
    )
