"""Token totals kept up to date by signed deltas.

A rollup lives in a folder all executors share. A batch holds changes of documents -
insert, revise or delete, each under a tokenizer version. Against the state of the
documents it touches, a batch becomes signed deltas: minus what a document counted
before, plus what it counts now, summed by source, language and version. Totals are
the sum of all deltas, so they never need the documents again.

A batch is committed by one small record that names its folder: a file written beside
and renamed, without replacing, to the name of its place in the order. A writer lost
before the rename leaves files that no reader looks at; of two writers after the same
place one finds it taken and works again on top of the other. A batch id that has a
record is not applied again, so a repeated batch changes nothing. Readers see whole
batches only.

Every ``COMPACT`` batches a snapshot is committed: the documents that are present, the
totals and the ids of all batches so far. Readers start from the last snapshot, so
what an apply reads is the snapshot and fewer than ``COMPACT`` batches.

Rows of one batch with the same document and version are one change: a deletion if any
of them deletes, else the row with the highest count (then source, language). Inserting a
document that is there, or revising one that isn't, sets its count; deleting one that
isn't there does nothing. Null counts are zero; null keys, sources, languages and
versions are values like any other. An empty batch commits and changes nothing.
Other columns are not used.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import RankCodec
from .names import free_name

GROUP = ["source", "lang", "tokenizer"]
_STATE = "doc_id long, source string, lang string, tokenizer string, n_tokens long, present boolean, seq long"
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Batches after which a snapshot is written.
COMPACT = 32


@dataclass(frozen=True)
class Record:
    """A committed batch, or a snapshot of all before it, which has no batch id."""

    seq: int
    batch_id: str | None
    folder: str


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The other columns of ``docs`` with ``n_tokens`` of the text; null counts as empty."""
    kept = [c for c in docs.columns if c.lower() not in {text.lower(), "n_tokens"}]
    body = F.col(f"`{text}`").cast("string").alias(free_name("_text", kept))
    source = docs.select(*[F.col(f"`{c}`") for c in kept], body)
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = RankCodec.of(path)
        for batch in batches:
            counts = [len(codec.encode(x)) for x in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(n) for n in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], schema.names)

    return source.mapInArrow(run, schema)


class TokenRollup:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[Record]:
        """The last snapshot, if there is one, and the batches committed after it, oldest first."""
        files = self._files()
        if not files.exists(self._path("commits")):
            return []
        names = sorted(status.getPath().getName() for status in files.listStatus(self._path("commits")))
        found: list[Record] = []
        for name in reversed(names):
            stream = files.open(self._path("commits", name))
            try:
                found.append(Record(**json.loads(bytes(stream.readAllBytes()))))
            finally:
                stream.close()
            if found[-1].batch_id is None:
                break
        return found[::-1]

    def _commit(self, record: Record) -> bool:
        """Put the record at its place; False if another writer's is there."""
        spark = self.spark.sparkContext
        files, hadoop = self._files(), spark._jvm.org.apache.hadoop.fs
        files.mkdirs(self._path("commits"))
        written = self._path("attempts", uuid.uuid4().hex)
        stream = files.create(written, False)
        try:
            stream.write(bytearray(json.dumps(asdict(record)).encode()))
        finally:
            stream.close()
        rename = getattr(hadoop, "Options$Rename")
        options = spark._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        place = files.makeQualified(self._path("commits", f"{record.seq:012d}"))
        context = hadoop.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
        try:
            context.rename(files.makeQualified(written), place, options)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def _read(self, part: str, schema: str, records: list[Record] | None = None) -> DataFrame:
        records = self.commits() if records is None else records
        folders = [f"{r.folder}/{part}" for r in records]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _has(self, batch_id: str, done: list[Record]) -> bool:
        if any(r.batch_id == batch_id for r in done):
            return True
        older = [r for r in done if r.batch_id is None]
        return not self._read("batches", "batch_id string", older).filter(F.col("batch_id") == batch_id).isEmpty()

    def compact(self) -> bool:
        """Commit a snapshot of everything so far; False if another writer was faster."""
        done = self.commits()
        seq = 1 + max((r.seq for r in done), default=0)
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        state = self._latest(done=done).filter("present").withColumn("seq", F.lit(seq).cast("long"))
        state.select("doc_id", *GROUP, "n_tokens", "present", "seq").write.parquet(f"{folder}/state")
        self._totals(done).write.parquet(f"{folder}/delta")
        ids = self.spark.createDataFrame([(r.batch_id,) for r in done if r.batch_id is not None], "batch_id string")
        older = self._read("batches", "batch_id string", [r for r in done if r.batch_id is None])
        older.unionByName(ids).write.parquet(f"{folder}/batches")
        return self._commit(Record(seq, None, folder))

    def _latest(self, keys: DataFrame | None = None, done: list[Record] | None = None) -> DataFrame:
        """The last state of documents; of those in ``keys`` only, if given."""
        state = self._read("state", _STATE, done)
        if keys is not None:
            same = state["doc_id"].eqNullSafe(keys["k_doc"]) & state["tokenizer"].eqNullSafe(keys["k_tokenizer"])
            state = state.join(keys, same, "left_semi")
        last = state.groupBy("doc_id", "tokenizer").agg(F.max_by(F.struct("source", "lang", "n_tokens", "present"), "seq").alias("s"))
        return last.select("doc_id", "tokenizer", "s.*")

    def apply(self, changes: DataFrame, batch_id: str) -> bool:
        """Commit ``changes`` (action, doc_id, source, lang, tokenizer, n_tokens); False if it was before."""
        while True:
            done = self.commits()
            if self._has(batch_id, done):
                return False
            if sum(r.batch_id is not None for r in done) >= COMPACT:
                self.compact()
            elif self._commit(self._written(changes, batch_id, done)):
                return True

    def _written(self, changes: DataFrame, batch_id: str, done: list[Record]) -> Record:
        """State and deltas of the batch after those ``done``, not yet committed."""
        seq = 1 + max((r.seq for r in done), default=0)
        deletes = (F.lower("action") == "delete").cast("int")
        row = F.struct(deletes.alias("gone"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "source", "lang")
        new = changes.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "tokenizer").agg(F.max(row).alias("r"))
        new = new.select(
            "doc_id", "r.source", "r.lang", "tokenizer", "r.n_tokens",
            (F.coalesce("r.gone", F.lit(0)) == 0).alias("present"), F.lit(seq).cast("long").alias("seq"),
        )
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        new.write.parquet(f"{folder}/state")
        new = self.spark.read.schema(_STATE).parquet(f"{folder}/state")
        signed = new.filter("present").select(*GROUP, F.lit(1).alias("n_docs"), "n_tokens")
        if done:
            keys = new.select(F.col("doc_id").alias("k_doc"), F.col("tokenizer").alias("k_tokenizer"))
            old = self._latest(keys, done).filter("present")
            signed = signed.unionByName(old.select(*GROUP, F.lit(-1).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens")))
        sums = signed.groupBy(*GROUP).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))
        sums.write.parquet(f"{folder}/delta")
        return Record(seq, batch_id, folder)

    def _totals(self, done: list[Record] | None = None) -> DataFrame:
        sums = self._read("delta", _DELTA, done).groupBy(*GROUP)
        sums = sums.agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))
        return sums.filter("n_docs != 0 or n_tokens != 0")

    def totals(self) -> DataFrame:
        """``n_docs`` and ``n_tokens`` by source, language and tokenizer version, without empty groups."""
        return self._totals()

    def recount(self) -> DataFrame:
        """The totals computed from the documents' states, to audit the deltas."""
        rows = self._latest().filter("present").groupBy(*GROUP)
        return rows.agg(F.count("*").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))
