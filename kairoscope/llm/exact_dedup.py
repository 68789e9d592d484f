"""Exact deduplication by Grace hash partitioning.

1. Every input task passes its normalised texts through an open-addressing table
   and sends on one record per distinct text: content, smallest key, count. A group
   that holds a third of all rows leaves a task as one record.
2. The records are partitioned by hash bits. The bytes of distinct content under
   each prefix of bits decide the buckets: a prefix with more than ``BUCKET_BYTES``
   is split by further bits, level after level, until each bucket fits or cannot be
   told apart by its hash. The shuffle files are the spill files: they survive the
   loss of an executor by recomputation and need no local folder.
3. Each bucket is read through an open-addressing table that compares the complete
   content, and gives one row per distinct text.
4. Rows get their group's values by a join on the digest of the normalised text;
   runtime skew handling splits a hot digest.

Texts are equal when identical after replacing each run of ``[\\x20\\x09-\\x0D]`` by one
space. A null text counts as empty. The smallest key stays; null keys come last. Of
repeated rows with the same key and text one stays. An empty table gives an empty
result. Columns whose names clash with the result's are replaced by the result's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .names import hidden_name, hide, show
from .workers import tidy

#: Distinct content of a bucket's table. A bucket's own records come on top, a batch at a time.
BUCKET_BYTES = 64 << 20
#: Content a map task holds before it sends on what it has.
TASK_BYTES = 16 << 20
#: Content of a batch that a table gives.
ROWS_BYTES = 2 << 20
HASH_BITS = 63
FIRST_BITS = 6

ORACLE = r"""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = min(doc_id) over w as kept, sha256(norm) as text_sha256
from t window w as (partition by norm)
"""


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class OpenTable:
    """Linear probing over 64-bit hashes; a slot matches on hash and whole content."""

    def __init__(self, slots: int = 1024):
        self.slots = np.full(slots, -1, np.int64)
        self.hash: list[int] = []
        self.content: list[str] = []
        self.key: list[int | None] = []
        self.count: list[int] = []
        self.bytes = 0

    def _place(self, hash_: int, content: str | None) -> int:
        mask = len(self.slots) - 1
        at = hash_ & mask
        while (entry := int(self.slots[at])) >= 0:
            if content is not None and self.hash[entry] == hash_ and self.content[entry] == content:
                return at
            at = (at + 1) & mask
        return at

    def add(self, hash_: int, content: str, key: int | None, count: int) -> None:
        if 2 * len(self.hash) >= len(self.slots):
            self.slots = np.full(4 * len(self.slots), -1, np.int64)
            for entry, known in enumerate(self.hash):
                self.slots[self._place(known, None)] = entry
        at = self._place(hash_, content)
        entry = int(self.slots[at])
        if entry < 0:
            self.slots[at] = len(self.hash)
            self.hash.append(hash_)
            self.content.append(content)
            self.key.append(key)
            self.count.append(count)
            self.bytes += len(content) + 120
            return
        self.count[entry] += count
        if key is not None and (self.key[entry] is None or key < self.key[entry]):
            self.key[entry] = key

    def rows(self, contents: bool) -> Iterator[pa.RecordBatch]:
        """The groups in batches of a bounded size."""
        low = size = 0
        for n, content in enumerate(self.content):
            size += len(content)
            if size > ROWS_BYTES or n == len(self.content) - 1:
                part = slice(low, n + 1)
                columns = [pa.array(self.hash[part], pa.int64())]
                if contents:
                    columns.append(pa.array(self.content[part], pa.string()))
                columns += [pa.array(self.key[part], pa.int64()), pa.array(self.count[part], pa.int64())]
                names = ["h", *["content"] * contents, "keep_id", "group_size"]
                if not contents:
                    columns.append(pa.array(self.digest(part), pa.binary()))
                    names.append("digest")
                yield pa.RecordBatch.from_arrays(columns, names)
                low, size = n + 1, 0

    def digest(self, part: slice) -> list[bytes]:
        import hashlib

        return [hashlib.sha256(x.encode()).digest() for x in self.content[part]]


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = OpenTable()
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in range(4)), strict=True):
            table.add(*row)
        if table.bytes > TASK_BYTES:
            yield from table.rows(True)
            table = OpenTable()
    yield from table.rows(True)


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, bucket = OpenTable(), None
    for batch in batches:
        for leaf, *row in zip(*(batch.column(n).to_pylist() for n in range(5)), strict=True):
            if leaf != bucket:
                yield from table.rows(False)
                table, bucket = OpenTable(), leaf
            table.add(*row)
    yield from table.rows(False)


def _prefix(bits: int) -> Column:
    """The first ``bits`` of the non-negative hash, with a leading one so that levels don't mix."""
    return F.shiftright(F.col("h"), HASH_BITS - bits) + F.lit(1 << bits)


def leaf_buckets(sizes: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[Column, int]:
    """The bucket of a hash ``h``, and about how many buckets there are.

    ``sizes`` has one row (h, bytes) per distinct hash. Only prefixes that are too
    large come to the driver, at most total / bucket_bytes of them at a level.
    """
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bits = max(FIRST_BITS, (4 * total // bucket_bytes).bit_length())
    leaf, count, open_ = _prefix(bits), 1 << bits, sizes
    while bits < HASH_BITS:
        grouped = open_.groupBy(_prefix(bits).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        large = [r.prefix for r in grouped.filter((F.col("bytes") > bucket_bytes) & (F.col("n") > 1)).collect()]
        if not large:
            break
        open_ = open_.filter(_prefix(bits).isin(large))
        deeper = min(HASH_BITS, bits + 4)
        leaf = F.when(leaf.isin(large), _prefix(deeper)).otherwise(leaf)
        count += len(large) << (deeper - bits)
        bits = deeper
    return leaf, count


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``docs`` but the text, with ``keep_id``, ``group_size``, ``kept``
    and ``text_sha256``; one row per input row."""
    docs, back = hide(docs)
    key, text = hidden_name(key, back), hidden_name(text, back)
    taken = {"keep_id", "group_size", "kept", "text_sha256", text.lower()}
    kept = [c for c in docs.columns if c.lower() not in taken]
    normal = normalised(F.col(f"`{text}`").cast("string"))
    hashed = docs.select(
        F.col(f"`{key}`").cast("long").alias("key"), normal.alias("content")
    ).select("key", "content", F.xxhash64("content").bitwiseAND(F.lit((1 << HASH_BITS) - 1)).alias("h"))
    sizes = stage(hashed.groupBy("h").agg(F.max(F.octet_length("content")).cast("long").alias("bytes")), "sizes")
    leaf, count = leaf_buckets(sizes, bucket_bytes)
    records = hashed.select("h", "content", "key", F.lit(1).cast("long").alias("group_size")).mapInArrow(
        tidy(_combine), "h long, content string, keep_id long, group_size long"
    )
    buckets = records.withColumn("leaf", leaf).select("leaf", "h", "content", "keep_id", "group_size")
    dealt = buckets.repartition(count, "leaf").sortWithinPartitions("leaf")
    groups = dealt.mapInArrow(tidy(_resolve), "h long, keep_id long, group_size long, digest binary")
    same_row = Window.partitionBy("_key", "_digest").orderBy(F.lit(1))
    rows = docs.select(
        *[F.col(f"`{c}`") for c in kept], F.col(f"`{key}`").cast("long").alias("_key"),
        F.unhex(F.sha2(normal.cast("binary"), 256)).alias("_digest"),
    ).withColumn("_copy", F.row_number().over(same_row))
    found = rows.join(groups.select(F.col("digest").alias("_digest"), "keep_id", "group_size"), "_digest")
    found = found.select(
        *[F.col(f"`{c}`") for c in kept], "keep_id", "group_size",
        (F.col("_key").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )
    return show(found, back)
