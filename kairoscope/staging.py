"""Intermediate tables in the folder all executors share.

A staged table cuts lineage: an executor lost later re-reads files instead of
recomputing, and two branches that read it see the very same rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; local sessions may fall back."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether rows that are placed by one of several join keys have to move for the join.
_MOVE = "spark.sql.requireAllClusterKeysForCoPartition"


def stage(df: DataFrame, name: str, beside: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet and read it back. With ``beside``, joins leave bucketed rows where they are."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_MOVE)
    if beside:
        spark.conf.set(_MOVE, "false")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_MOVE, before)
    return spark.read.schema(df.schema).parquet(path)


def stage_buckets(df: DataFrame, name: str, column: str) -> DataFrame:
    """``stage`` for large rows, bucketed by ``column``: a join on it leaves them where they are."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, column).option("path", path).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)
