"""Status, metric and indexing streams over append-only logs.

Every stream is an ordinary DataFrame transformation plus :func:`drain`, which
runs it over the input available now. Micro-batches are written to one folder
per batch id, so a batch that is retried replaces its own output.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.temporal import JOB_EDGES
from ..staging import new_path


def read_log(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """A file-source stream; the schema is always explicit."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drain(
    stream: DataFrame, mode: str, name: str, folder: str | None = None, keys: list[str] | None = None
) -> tuple[DataFrame, list[dict]]:
    """Process what is available; return the result table and this run's progress reports.

    ``complete`` results are the last batch's table, ``append`` results all batches
    together. ``update`` results need the ``keys`` of a row: of its versions the one of
    the latest batch stays. A call with the ``folder`` of an earlier one
    goes on where that stopped, and its result includes the earlier batches.
    Reports are gathered batch by batch: the engine itself forgets all but the last.
    """
    if mode == "update" and not keys:
        raise ValueError("update mode returns versions of rows: name their keys")
    spark = stream.sparkSession
    folder = folder or new_path(spark, name)
    out = f"{folder}/out"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")
    reports: dict[int, dict] = {}
    running: list = []

    def note(found) -> None:
        reports.update((p["batchId"], dict(p)) for p in found if p is not None)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if running:
            note([running[0].lastProgress])

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    running.append(query)
    query.awaitTermination()
    note(query.recentProgress)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    table = spark.read.schema(schema).parquet(out)
    if mode == "complete":
        table = table.filter(F.col("batch") == (table.agg(F.max("batch")).first()[0] or 0))
    elif mode == "update":
        rest = [c for c in table.columns if c not in (*keys, "batch")]
        last = table.groupBy(*keys, "batch").agg(*[F.first(c).alias(c) for c in rest]).groupBy(*keys)
        table = last.agg(F.max_by(F.struct(*rest, "batch"), "batch").alias("_last")).select(*keys, "_last.*").select(*table.columns)
    return table.drop("batch"), [reports[n] for n in sorted(reports)]


def latest_status(log: DataFrame) -> DataFrame:
    """Latest status per job (complete or update mode)."""
    last = F.max_by(F.struct("status", "event_id"), F.struct("ts", "event_id"))
    return log.groupBy("job_id").agg(last.alias("_last")).select("job_id", "_last.*")


def windowed_latency(log: DataFrame, value: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and mean per time window and metric name; tumbling, or sliding with ``slide``."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        log.withWatermark("ts", late)
        .groupBy(w.alias("w"), "name")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
        .select(F.col("w.start").alias("window_start"), "name", "n", "mean")
    )


def sessions(log: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions per key separated by more than ``gap``."""
    return (
        log.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
    )


def accepted_chunks(chunks: DataFrame, late: str) -> DataFrame:
    """Chunk writes without replays of the same (upload, index, content)."""
    return chunks.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["upload_id", "idx", "sha256"])


class JobChecker(StatefulProcessor):
    """Checks a job's rows in order of time once no earlier row can come.

    Rows wait in the state until the watermark has passed them; a timer for the
    earliest one wakes the job. Only its last status is kept beyond that.
    """

    WAITING = "ts long, event_id long, status string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string")
        self.alarm = handle.getValueState("alarm", "at long")
        self.waiting = handle.getListState("waiting", self.WAITING)
        self.edges = set(JOB_EDGES)

    def _wake_at(self, micros: int) -> None:
        """A timer for the earliest waiting row; an earlier one than before takes its place."""
        at, old = -(-micros // 1000), self.alarm.get()
        if old is not None and old[0] <= at:
            return
        if old is not None:
            self.handle.deleteTimer(old[0])
        self.handle.registerTimer(at)
        self.alarm.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            new = [(int(t), int(e), s) for t, e, s in zip(part["micros"], part["event_id"], part["status"], strict=True)]
            if new:
                self.waiting.appendList(new)
                self._wake_at(min(t for t, _, _ in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get())
        due = [r for r in rows if r[0] <= passed]
        rest = rows[len(due) :]
        self.alarm.clear()
        if rest:
            self.waiting.put(rest)
            self._wake_at(rest[0][0])
        else:
            self.waiting.clear()
        known = self.last.get()
        before, bad = known[0] if known else "", []
        for micros, event, status in due:
            if before != status and (before, status) not in self.edges:
                bad.append((key[0], event, pd.Timestamp(micros, unit="us", tz="UTC"), status, before or None))
            before = status
        if due:
            self.last.update((before,))
        if bad:
            yield pd.DataFrame(bad, columns=["job_id", "event_id", "ts", "status", "previous_status"])

    def close(self) -> None:
        pass


def transition_stream(log: DataFrame, late: str = "1 hour", folder: str | None = None) -> DataFrame:
    """Invalid job state changes of a status log (``job_id, event_id, ts, status``), as a table.

    Rows may come in any order as long as none is later than ``late``: they are judged in
    the order of (time, event id), as the batch operator does. Rows that are later are refused
    by the watermark, and rows the watermark has not passed yet wait in the state store;
    calling again with the same ``folder`` goes on there. A null status counts as no state;
    rows without a time or an event id have no place in the order and are left out.
    """
    spark = log.sparkSession
    timed = log.select(
        "job_id", F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.coalesce("status", F.lit("")).alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
    ).filter("ts is not null and event_id is not null").withWatermark("ts", late)
    schema = T.StructType(
        [timed.schema["job_id"], T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
         T.StructField("status", T.StringType()), T.StructField("previous_status", T.StringType())]
    )
    checked = timed.groupBy("job_id").transformWithStateInPandas(JobChecker(), schema, "Append", "EventTime")
    provider, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(provider)
    spark.conf.set(provider, store)  # timers and lists need this store
    try:
        return drain(checked, "append", "transitions", folder)[0]
    finally:
        spark.conf.set(provider, before)


#: Folders of an index. A batch reads the keys of those its own keys fall into.
INDEX_BUCKETS = 64


def index_stream(
    frames: DataFrame, embed, table_path: str, key: str = "frame_id", folder: str | None = None, buckets: int = INDEX_BUCKETS
) -> None:
    """Embed newly arrived frames and append those whose key is not indexed yet.

    ``embed`` maps a frame DataFrame to index rows. Keys are deterministic, so
    replaying the same input, or retrying a batch, adds nothing twice. The table is
    partitioned by a hash of the key (column ``bucket``): a batch looks its keys up in the
    folders they belong to and reads no other. A call with
    the ``folder`` of an earlier one reads only what has arrived since.
    """
    spark = frames.sparkSession
    schema = T.StructType([*embed(frames).schema.fields, T.StructField("bucket", T.IntegerType())])
    spark.createDataFrame([], schema).write.mode("append").partitionBy("bucket").parquet(table_path)
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")

    def add(batch: DataFrame, batch_id: int) -> None:
        arrived = batch.dropDuplicates([key])
        touched = [r[0] for r in arrived.select(bucket.alias("bucket")).distinct().collect()]  # at most ``buckets``
        known = spark.read.schema(schema).parquet(table_path).filter(F.col("bucket").isin(touched)).select(key)
        new = arrived.join(known, key, "left_anti")
        embed(new).withColumn("bucket", bucket).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(table_path)

    query = (
        frames.writeStream.option("checkpointLocation", folder or new_path(spark, "index-progress"))
        .trigger(availableNow=True)
        .foreachBatch(add)
        .start()
    )
    query.awaitTermination()


def split_late(log: DataFrame, length: str, late: str, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows in time and rows the watermark refuses, as two tables with the columns of ``log`` and ``window_end``.

    A row of ``ts`` is refused when its window of the given length has ended ``late`` before the
    latest time of all earlier batches, which is when a windowed aggregation drops it. Rows
    are split before they are aggregated, so every single one is accounted for. The latest
    time of each batch is written beside its rows; a batch that is retried writes the same again.
    """
    spark = log.sparkSession
    folder = folder or new_path(spark, "late-rows")
    # Not by window(), which leaves out rows without a time.
    at, width = F.unix_micros(F.col("ts").cast("timestamp")), F.expr(f"unix_micros(timestamp_micros(0) + interval {length})")
    placed = log.withColumn("window_end", F.timestamp_micros(at - F.pmod(at, width) + width))
    seen = T.StructType([T.StructField("latest", T.TimestampType()), T.StructField("batch", T.LongType())])

    def split(batch: DataFrame, batch_id: int) -> None:
        earlier = spark.read.schema(seen).parquet(f"{folder}/seen").filter(F.col("batch") < batch_id)
        passed = earlier.agg((F.max("latest") - F.expr(f"interval {late}")).alias("passed"))
        marked = batch.join(F.broadcast(passed)).withColumn("_late", F.coalesce(F.col("window_end") <= F.col("passed"), F.lit(False)))
        marked.drop("passed").write.mode("overwrite").partitionBy("_late").parquet(f"{folder}/rows/batch={batch_id}")
        batch.agg(F.max("ts").alias("latest")).write.mode("overwrite").parquet(f"{folder}/seen/batch={batch_id}")

    spark.createDataFrame([], seen).drop("batch").write.mode("overwrite").parquet(f"{folder}/seen/batch=-1")
    query = placed.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(split).start()
    query.awaitTermination()
    rows = T.StructType([*placed.schema.fields, T.StructField("batch", T.LongType()), T.StructField("_late", T.BooleanType())])
    spark.createDataFrame([], T.StructType(rows.fields[:-2])).write.mode("overwrite").parquet(f"{folder}/rows/batch=-1/_late=false")
    found = spark.read.schema(rows).parquet(f"{folder}/rows")
    return found.filter("not _late").select(*placed.columns), found.filter("_late").select(*placed.columns)


def dropped_late_rows(progress: list[dict]) -> int:
    """Rows the stateful operators say they refused because of the watermark.

    Spark counts them after partial aggregation, so this is a lower bound of input rows;
    :func:`split_late` counts them exactly.
    """
    return sum(
        int(op.get("numRowsDroppedByWatermark", 0)) for p in progress for op in p.get("stateOperators", [])
    )
