"""Document fingerprints by context-triggered piecewise hashing.

A hash rolls over every seven bytes of a text. Where its low bits are zero a chunk
ends, so the chunk borders follow the content and shift with it. Each chunk becomes
two letters of its hash; the letters of all chunks are the text's signature. The
number of low bits, the block size, is the smallest that leaves at most ``CHUNKS``
borders in the whole text, so a signature is bounded and still covers every byte.
A fingerprint is ``size:signature:coarser:coarsest``, the others for two and four times
the block size, so that texts whose sizes differ by up to two steps can be compared.

The likeness of two fingerprints is one minus the edit distance of two signatures of
the same block size, in chunks, over the longer one; the better of the block sizes
they share counts. It is 1 for equal fingerprints and 0 where no block size is shared.

:func:`fingerprint_texts` works where the rows are. :func:`compare_with_next` needs
neighbours in the order of the keys: one range partitioning, which splits even rows of
one key, then a stream through each partition that keeps a single text. Only the first
and the last row of each partition are kept aside, written, and met in a second step.

A null text counts as empty; an empty text has the fingerprint ``2:::``. Very long texts
are read whole, in blocks; only the text and a byte per position are in memory. Rows are
ordered by descending key, null keys last, ties by hash of their text, so repeated rows
follow each other; a single row is its own next one. An empty table gives no rows.
:func:`fingerprint_texts` passes other columns through unless they have the name of a
result; :func:`compare_with_next` does not use them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import stage
from .bpe import text_groups

WINDOW = 7
#: At most so many chunk borders; signatures have one chunk more at most.
CHUNKS = 64
#: Block sizes are powers of two from this one on.
LOWEST = 1
#: Signatures in a fingerprint, each for the double block size of the one before.
GRAINS = 3
#: Bytes of text that a task of the range partitioning should get.
TASK_BYTES = 64 << 20
#: Bytes hashed at a time.
BLOCK = 1 << 18
#: Pairs whose edit distances are computed together.
PAIRS = 512
#: The letters of signatures.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

_MIX = (1 << 32) - 5 * 211
_FACTOR = 0x01000193
#: A number for each byte; the zeros before a text count as nothing.
_SPREAD = ((np.arange(256, dtype=np.uint64) * 0x9E3779B97F4A7C15 >> np.uint64(29)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
_PLACE = {letter: n for n, letter in enumerate(LETTERS)}
_PAIR = [a + b for a in LETTERS for b in LETTERS]


def _borders(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places where the hash of the last seven bytes ends in ``LOWEST`` zero bits, and how many it has."""
    given = np.frombuffer(data, np.uint8)
    places, levels = [], []
    for low in range(0, len(given), BLOCK):
        first = max(0, low - WINDOW + 1)
        spread = _SPREAD[given[first : low + BLOCK]]
        rolled = spread.copy()
        for back in range(1, WINDOW):
            rolled[back:] += spread[:-back] * np.uint32(pow(_FACTOR, back, 1 << 32))
        rolled ^= rolled >> np.uint32(15)
        rolled *= np.uint32(_MIX)
        rolled ^= rolled >> np.uint32(13)
        rolled = rolled[low - first :]
        at = np.flatnonzero((rolled & np.uint32((1 << LOWEST) - 1)) == 0)
        value = rolled[at]
        lowest = (value & (~value + np.uint32(1))).astype(np.float32)
        bits = (lowest.view(np.int32) >> 23) - 127
        places.append(at + low)
        levels.append(np.where(value == 0, 32, bits).astype(np.int8))
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int8)
    return np.concatenate(places), np.concatenate(levels)


#: The block size as a power of two, and a signature for each grain.
Signature = tuple[int, list[list[int]]]


def _sign(data: bytes, start: int, stop: int, ends: list[int]) -> list[int]:
    """A number below 4096 for each chunk of ``data[start:stop]``."""
    codes = []
    for end in ends:
        codes.append(crc32(data[start : end + 1]) >> 20)
        start = end + 1
    if start < stop:
        codes.append(crc32(data[start:stop]) >> 20)
    return codes


def signatures(texts: list[bytes]) -> list[Signature]:
    """Block sizes and signatures of whole texts."""
    gap = bytes(WINDOW)
    data = gap.join(texts)
    places, levels = _borders(data)
    found, start = [], 0
    for text in texts:
        stop = start + len(text)
        a, b = np.searchsorted(places, (start, stop))
        own, level = places[a:b], levels[a:b]
        size = LOWEST
        if b - a > CHUNKS:
            at_least = np.bincount(level, minlength=34)[::-1].cumsum()[::-1]
            size = LOWEST + int(np.argmax(at_least[LOWEST:] <= CHUNKS))
            own, level = own[level >= size], level[level >= size]
        found.append((size, [_sign(data, start, stop, own[level >= size + n].tolist()) for n in range(GRAINS)]))
        start = stop + WINDOW
    return found


def spell(signature: Signature) -> str:
    size, grains = signature
    return ":".join([str(1 << size), *["".join(map(_PAIR.__getitem__, codes)) for codes in grains]])


def parse(fingerprint: str) -> Signature:
    size, *parts = fingerprint.split(":")
    read = lambda s: [_PLACE[a] * 64 + _PLACE[b] for a, b in zip(s[::2], s[1::2], strict=True)]
    return int(size).bit_length() - 1, [read(part) for part in parts]


def edit_distances(pairs: list[tuple[list[int], list[int]]]) -> np.ndarray:
    """Edit distance of each pair of bounded sequences, all pairs a row at a time."""
    out = np.empty(len(pairs), np.int64)
    for low in range(0, len(pairs), PAIRS):
        some = pairs[low : low + PAIRS]
        n = np.array([len(a) for a, _ in some])
        m = np.array([len(b) for _, b in some])
        left = np.full((n.max(initial=0), len(some)), -1, np.int16)
        right = np.full((len(some), m.max(initial=0)), -2, np.int16)
        for i, (a, b) in enumerate(some):
            left[: len(a), i] = a
            right[i, : len(b)] = b
        column = np.arange(right.shape[1] + 1, dtype=np.int16)
        row = np.tile(column, (len(some), 1))
        found = np.where(n == 0, m, 0)
        for i, letters in enumerate(left):
            best = np.empty_like(row)
            best[:, 0] = i + 1
            np.minimum(row[:, 1:] + 1, row[:, :-1] + (right != letters[:, None]), out=best[:, 1:])
            # An insertion adds one for each step to the right: a running minimum, free of the steps.
            row = np.minimum.accumulate(best - column, axis=1) + column
            ended = np.flatnonzero(n == i + 1)
            found[ended] = row[ended, m[ended]]
        out[low : low + len(some)] = found
    return out


def likenesses(pairs: list[tuple[Signature, Signature]]) -> list[float]:
    """How alike two fingerprints are, 0 to 1."""
    result = [0.0] * len(pairs)
    owners, todo = [], []
    for i, (left, right) in enumerate(pairs):
        if left == right:
            result[i] = 1.0
            continue
        step = right[0] - left[0]
        for a, b in zip(left[1][max(0, step) :], right[1][max(0, -step) :], strict=False):
            if a or b:
                owners.append(i)
                todo.append((a, b))
    for i, (a, b), distance in zip(owners, todo, edit_distances(todo).tolist(), strict=True):
        result[i] = max(result[i], 1 - distance / max(len(a), len(b)))
    return result


def fingerprint_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_chars`` (code points) and ``fingerprint``; no shuffle."""
    added = [T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())]
    kept = [c for c in docs.columns if c.lower() not in {f.name for f in added}]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), body.alias("body"))
    schema = T.StructType([source.schema["row"], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low, high in text_groups(texts):
                some = texts[low:high]
                signed = signatures([t.encode() for t in some])
                columns = [batch.column(0).slice(low, high - low), pa.array(map(len, some), pa.int64()), pa.array(map(spell, signed), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    found = source.mapInArrow(run, schema)
    return found.select(*[F.col("row")[c].alias(c) for c in kept], "n_chars", "fingerprint")


def likeness(pairs: DataFrame, left: str, right: str, name: str = "likeness") -> DataFrame:
    """``pairs`` with the likeness of two fingerprint columns; null where one is null."""
    kept = [c for c in pairs.columns if c.lower() != name.lower()]
    source = pairs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{left}`").alias("left"), F.col(f"`{right}`").alias("right"))
    schema = T.StructType([source.schema["row"], T.StructField("found", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            known = [i for i, (a, b) in enumerate(both) if a is not None and b is not None]
            values: list[float | None] = [None] * len(both)
            for i, value in zip(known, likenesses([(parse(both[i][0]), parse(both[i][1])) for i in known]), strict=True):
                values[i] = value
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], schema.names)

    found = source.mapInArrow(run, schema)
    return found.select(*[F.col("row")[c].alias(c) for c in kept], F.col("found").alias(name))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = [
    ("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()),
    ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()),
]


def _compare(texts: list[str], following: list[str], signed: list[Signature], following_signed: list[Signature]) -> list[list]:
    """The result columns for each text and the one that follows it."""
    changed = [edited(a, b).encode() for a, b in zip(texts, following, strict=True)]
    changed_signed = signatures(changed)
    return [
        [len(t) for t in texts],
        [hashlib.sha256(t).hexdigest() for t in changed],
        [spell(s) for s in signed],
        [spell(s) for s in changed_signed],
        likenesses(list(zip(signed, changed_signed, strict=True))),
        likenesses(list(zip(signed, following_signed, strict=True))),
    ]


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", task_bytes: int = TASK_BYTES) -> DataFrame:
    """Each document beside the next one by descending key, the first after the last.

    Columns: the key, ``n_chars``, ``edited_sha256`` (of the text whose last half is
    replaced by the beginning of the next document's), ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``, the likeness of the
    fingerprint to the edited text's and to the next document's.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    size = source.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // task_bytes))
    order = [F.desc("key"), F.xxhash64("body"), F.monotonically_increasing_id()]
    ordered = source.repartitionByRange(tasks, *order).sortWithinPartitions(F.desc("key"), F.xxhash64("body"))
    result = [T.StructField(name, kind) for name, kind in _RESULT]
    edge = [("part", T.LongType()), ("is_head", T.BooleanType()), ("body", T.StringType())]
    schema = T.StructType([source.schema["key"], *result, *[T.StructField(n, k) for n, k in edge]])
    key_type, types = T.StructType([source.schema["key"]]), [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def rows(keys: pa.Array, columns: list[list]) -> pa.RecordBatch:
        done = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        none = [pa.nulls(len(keys), t) for t in (pa.int64(), pa.bool_(), pa.string())]
        return pa.RecordBatch.from_arrays([keys, *done, *none], schema.names)

    def edge_row(key: pa.Array, head: bool, body: str) -> pa.RecordBatch:
        part = TaskContext.get().partitionId()
        columns = [key, *[pa.nulls(1, t) for t in types], pa.array([part], pa.int64()), pa.array([head]), pa.array([body], pa.string())]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_text, open_signed = None, "", None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low, high in text_groups(texts):
                some = texts[low:high]
                signed = signatures([t.encode() for t in some])
                keys = batch.column(0).slice(low, high - low)
                if open_key is None:
                    yield edge_row(keys.slice(0, 1), True, some[0])
                    whole, all_signed, all_keys = some, signed, keys
                else:
                    whole, all_signed, all_keys = [open_text, *some], [open_signed, *signed], pa.concat_arrays([open_key, keys])
                if len(whole) > 1:
                    yield rows(all_keys.slice(0, len(whole) - 1), _compare(whole[:-1], whole[1:], all_signed[:-1], all_signed[1:]))
                open_key, open_text, open_signed = all_keys.slice(len(whole) - 1), whole[-1], all_signed[-1]
        if open_key is not None:
            yield edge_row(open_key, False, open_text)

    walked = stage(ordered.mapInArrow(walk, schema), "fingerprints")
    edges = walked.filter(F.col("part").isNotNull())
    heads = edges.filter("is_head").select("part", F.col("body").alias("following"))
    # One narrow row for each task of the partitioning; their texts are joined, not gathered.
    in_order = Window.orderBy("part")
    parts = heads.select("part").withColumn("next_part", F.coalesce(F.lead("part").over(in_order), F.min("part").over(Window.partitionBy())))
    tails = edges.filter("not is_head").select("key", "part", "body").join(parts, "part")
    met = tails.join(heads.withColumnRenamed("part", "next_part"), "next_part").select("key", "body", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair = [batch.column(c)[i].as_py() for c in (1, 2)]
                signed = signatures([t.encode() for t in pair])
                yield pa.RecordBatch.from_arrays(rows(batch.column(0).slice(i, 1), _compare(pair[:1], pair[1:], signed[:1], signed[1:])).columns[:7], schema.names[:7])

    last = met.mapInArrow(finish, T.StructType([*key_type.fields, *result]))
    inner = walked.filter(F.col("part").isNull()).select("key", *[name for name, _ in _RESULT])
    return inner.unionByName(last).withColumnRenamed("key", key)
