"""Reading metadata, vector and media-file tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import accepted_upload, extension, media_kind


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def scan_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Frame vectors with their model stamps; callers' selects and filters reach the scan."""
    return read_table(spark, path)


def write_vectors(vectors: DataFrame, path: str, by: str = "cell_id") -> None:
    """Store coded vectors partitioned by retrieval cell, so probes prune whole folders."""
    vectors.write.mode("append").partitionBy(by).parquet(path)


INDEX_SCHEMA = (
    "frame_id string, video_id string, media_type string, timestamp double, embedding array<float>, code binary, cell_id int"
)


def scan_index(spark: SparkSession, path: str) -> DataFrame:
    """The coded vectors; the schema is fixed, so an empty index can be read as well."""
    return spark.read.schema(INDEX_SCHEMA).parquet(path)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; the equality reaches the Parquet scan."""
    return df.filter(F.col(key) == F.lit(value))


def list_media_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files under ``path`` with kind and acceptance; file contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    listed = reader.load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    no_mime = F.lit(None).cast("string")
    return listed.select(
        "path",
        name.alias("filename"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        extension(name).alias("extension"),
        media_kind(name, no_mime).alias("media_kind"),
        accepted_upload(name, no_mime).alias("accepted"),
    )
