"""Writing: appends, key rewrites, cascaded deletes and context exports.

Plain Parquet has no row-level update, so upserts and deletes build the new
table; callers write it to a new path and switch over, never onto their input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def saved_context_rows(results: DataFrame) -> DataFrame:
    """Search results in the shape of ``saved_contexts``."""
    return results.select(
        "query",
        "video_id",
        F.col("video_name").alias("filename"),
        "media_type",
        F.col("timestamp").alias("timestamp_seconds"),
        "timestamp_hms",
        "context_start",
        "context_end",
        F.col("similarity").alias("score"),
        F.expr("nullif(frame_id, '')").alias("frame_id"),
        F.coalesce(F.col("context_text"), X.context_text()).alias("context_text"),
        "context_frames",
        F.col("context_reason").alias("reason"),
    )


def saved_as_results(saved: DataFrame) -> DataFrame:
    """Saved contexts under the column names the exports use."""
    return saved.select(
        "query", "video_id", F.col("filename").alias("video_name"), "media_type",
        F.col("timestamp_seconds").alias("timestamp"), "timestamp_hms", "context_start", "context_end",
        F.lit(None).cast("string").alias("context_start_hms"), F.lit(None).cast("string").alias("context_end_hms"),
        F.col("score").alias("similarity"), "frame_id", F.lit("saved").alias("retrieval_stage"),
        "context_text", "context_frames", F.col("reason").alias("context_reason"),
        F.lit(None).cast("string").alias("context_summary"),
    )


EXPORTS = {
    "json": X.result_json,
    "csv": X.result_csv,
    "txt": lambda: F.coalesce(F.col("context_text"), X.context_text()),
    "plain": X.result_plain_text,
}


def export_lines(results: DataFrame, fmt: str) -> DataFrame:
    """One exported record per result as ``line``; no shuffle."""
    return results.withColumn("line", EXPORTS[fmt]())


def export_contexts(results: DataFrame, fmt: str, path: str) -> None:
    """Write all records as text. The first part of a CSV export is its header line, once,
    also when there is no record: the parts in order of their names are one file."""
    lines = export_lines(results, fmt).select("line")
    if fmt == "csv":
        header = results.sparkSession.range(0, 1, 1, 1).select(F.lit(X.CSV_HEADER).alias("line"))
        lines = header.unionByName(lines)
    lines.write.text(path)


def copy_all(results: DataFrame) -> DataFrame:
    """All blocks of a query as one text, numbered in rank order (``final_results`` rows at most)."""
    block = F.coalesce(F.col("context_text"), X.context_text())
    ordered = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("rank"), block.alias("block"))))
    numbered = F.transform(
        "blocks", lambda e, i: F.concat(F.lit("# Result "), (i + 1).cast("string"), F.lit("\n"), e["block"])
    )
    return results.groupBy("query_id").agg(ordered.alias("blocks")).select(
        "query_id", F.array_join(numbered, "\n\n").alias("copied_text")
    )


def upsert(old: DataFrame, new: DataFrame, key: str, update_columns: list[str], order: list[str]) -> DataFrame:
    """Insert new keys, update only ``update_columns`` of known ones.

    Of several incoming rows per key the last by ``order`` wins. The reduction is a
    partial aggregate, so one key with very many updates does not matter.
    """
    fields = [c for c in old.columns if c != key]
    incoming = new.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_new"))
    current = old.select(key, F.struct(*fields).alias("_old"))
    joined = current.join(incoming, key, "full_outer")

    def value(c: str) -> Column:
        newer, older = F.col("_new")[c], F.col("_old")[c]
        if c in update_columns:
            return F.when(F.col("_new").isNotNull(), newer).otherwise(older).alias(c)
        return F.when(F.col("_old").isNotNull(), older).otherwise(newer).alias(c)

    return joined.select(key, *[value(c) for c in fields])


def cascade_delete(tables: dict[str, DataFrame], doomed: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remaining rows of each table and a (table, deleted, kept) count table."""
    keys = doomed.select(key)
    remaining = {name: df.join(keys, key, "left_anti") for name, df in tables.items()}
    none = F.lit(0).cast("long")
    parts = []
    for name, df in tables.items():
        gone = df.join(keys, key, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
        parts.append(gone.select(F.lit(name).alias("table"), "deleted", none.alias("total")))
        parts.append(df.agg(F.count(F.lit(1)).alias("total")).select(F.lit(name).alias("table"), none.alias("deleted"), "total"))
    counts = reduce(DataFrame.unionByName, parts).groupBy("table").agg(
        F.sum("deleted").alias("deleted"), (F.sum("total") - F.sum("deleted")).alias("kept")
    )
    return remaining, counts


def delete_rows(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Remaining rows and a one-row ``deleted`` count (null conditions keep the row)."""
    gone = F.coalesce(condition, F.lit(False))
    return df.filter(~gone), df.agg(F.count_if(gone).alias("deleted"))
