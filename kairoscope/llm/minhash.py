"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is the multiset of its shingles of five words; the weight of a shingle is
its number of occurrences. Every element is a Poisson process whose arrivals, after
exponential waits divided by the weight, fall on random signature places; a place
keeps the element that arrives first. An element stops as soon as its arrival is later
than the latest place of its document (early termination), so a document of ``n``
shingles costs about ``n`` plus the arrivals that fill the signature. Two signatures
agree in a place with the probability Jaccard similarity of the weighted shingles.

With all weights one they agree with the Jaccard similarity of the shingle sets.

Signatures are cut into ``BANDS`` bands of ``ROWS`` places; documents that agree in a
band are candidates. A document that repeats shingles has the bands of two signatures,
one by weights and one with all weights one; without repeats both are the same. So any
two documents are candidates with probability 0.997 at a similarity of their shingle
sets of 0.8 and 0.9999 at 0.85, whatever they repeat. Candidates count as linked when
that similarity, computed exactly, is at least ``SIMILARITY``. Classes are the
connected components.

No group of candidates is expanded into all pairs. Documents of equal words are one
node. In each bucket the most popular node, which shares most buckets with most others,
is compared with the rest; buckets that are one component then are done. In what is
left more and more members of each bucket, chosen by a hash, are compared with the
members of other components, until every pair across components has been compared or
the bucket is one component; a pair is passed over without a comparison only when the
shingles that no other open document has already rule the similarity out. So no link
between candidates is lost, and work is spent only on pairs that may still join
components. All steps are joins and grouped
aggregates over narrow tables in the shared folder; nothing is collected.

Words are split at ``[\\x20\\x09-\\x0D]+``. A text of one to four words is one shingle.
Null, empty and blank texts have no shingles and are left alone, each in a class of
its own. Repeated rows are in one class. Null keys are carried along, and an empty table
gives an empty result. Result columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import stage
from .graph import linked
from .workers import tidy

WORDS = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 8
#: Words and rows handled at a time within a task; workers keep the memory of the largest group.
GROUP_WORDS = 100_000
GROUP_ROWS = 1_024
#: Contents whose ids are broadcast at most (32 bytes each); beyond it an ordinary join is used.
BROADCAST_ROWS = 500_000
_SPACE = r"[\x20\x09-\x0D]+"
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit value of each 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, their document and their count."""
    lengths = np.diff(offsets)
    counts = np.where(lengths >= WORDS, lengths - WORDS + 1, (lengths > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(lengths)), counts)
    begin = np.repeat(offsets[:-1], counts) + np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    hashed = np.zeros(len(doc), np.uint64)
    end = offsets[1:][doc]
    for n in range(WORDS):
        word = np.where(begin + n < end, padded[begin + n], np.uint64(0))
        hashed = _mix((hashed + word) * np.uint64(_STEP) + np.uint64(n + 1))
    order = np.lexsort((hashed, doc))
    doc, hashed = doc[order], hashed[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])
    at = np.flatnonzero(new)
    return hashed[at], doc[at], np.diff(np.append(at, len(doc)))


def signatures(hashed: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int, places: int = BANDS * ROWS) -> np.ndarray:
    """The ProbMinHash signature of each document; 0 everywhere without shingles."""
    first = np.full((docs, places), np.inf)
    kept = np.zeros((docs, places), np.uint64)
    active = np.arange(len(hashed))
    time = np.zeros(len(hashed))
    arrival = 0
    while len(active):
        arrival += 1
        h = hashed[active]
        u = _mix(h + np.uint64((2 * arrival * _STEP) & (2**64 - 1)))
        time = time - np.log1p(-(u >> np.uint64(11)).astype(float) * 2.0**-53) / weight[active]
        place = (_mix(h ^ np.uint64(((2 * arrival + 1) * _STEP) & (2**64 - 1))) >> np.uint64(32)).astype(np.int64) % places
        d = doc[active]
        cell = d * places + place
        # Only the earliest arrival in a cell counts; equal times are settled by the hash.
        earlier = time <= first.ravel()[cell]
        if earlier.any():
            c, t, e = cell[earlier], time[earlier], h[earlier]
            order = np.lexsort((e, t, c))
            c, t, e = c[order], t[order], e[order]
            lead = np.ones(len(c), bool)
            lead[1:] = c[1:] != c[:-1]
            c, t, e = c[lead], t[lead], e[lead]
            flat, elements = first.reshape(-1), kept.reshape(-1)
            better = (t < flat[c]) | (e < elements[c])
            flat[c[better]], elements[c[better]] = t[better], e[better]
        going = time <= first.max(axis=1)[d]
        active, time = active[going], time[going]
    return kept


def band_keys(kept: np.ndarray) -> np.ndarray:
    """One 64-bit key for each document and band."""
    parts = kept.reshape(len(kept), BANDS, ROWS)
    key = np.zeros(parts.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for n in range(ROWS):
        key = _mix(key * np.uint64(_STEP) + parts[:, :, n])
    return key.view(np.int64)


def bands(hashed: np.ndarray, doc: np.ndarray, count: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The band keys of all documents, one after the other, and where each document's begin.

    Keys of the signature with all weights one follow where they differ from those by counts.
    """
    weighted = band_keys(signatures(hashed, doc, count.astype(float), docs))
    plain = weighted.copy()
    repeats = np.flatnonzero(np.bincount(doc, count > 1, docs))
    own = np.isin(doc, repeats)
    plain[repeats] = band_keys(signatures(hashed[own], np.searchsorted(repeats, doc[own]), np.ones(own.sum()), len(repeats)))
    keep = np.concatenate([np.ones(weighted.shape, bool), plain != weighted], axis=1)
    return np.concatenate([weighted, plain], axis=1)[keep], np.append(0, np.cumsum(keep.sum(axis=1)))


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups of rows of a list column, bounded in number and in their words."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + GROUP_WORDS, "right")) - 1)
        high = min(high, low + GROUP_ROWS)
        yield low, high, values[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, words, offsets in _words(batch.column(batch.num_columns - 1)):
            hashed, doc, count = shingles(words, offsets)
            keys, bounds = bands(hashed, doc, count, high - low)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys, pa.int64()))
            columns = [batch.column(n).slice(low, high - low) for n in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, lists], [*batch.schema.names[:-1], "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, words, offsets in _words(batch.column(batch.num_columns - 1)):
            hashed, doc, _ = shingles(words, offsets)
            bounds = np.searchsorted(doc, np.arange(high - low + 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashed.view(np.int64), pa.int64()))
            columns = [batch.column(n).slice(low, high - low) for n in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, lists], [*batch.schema.names[:-1], "elements"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        a, b = (x.values.to_numpy(zero_copy_only=False) for x in (left, right))
        at, bt = left.offsets.to_numpy(), right.offsets.to_numpy()
        linked = np.zeros(len(batch), bool)
        for n in range(len(batch)):
            x, y = a[at[n] : at[n + 1]], b[bt[n] : bt[n + 1]]
            if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked[n] = both >= SIMILARITY * (len(x) + len(y) - both) - 1e-9
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(linked)), batch.column(1).filter(pa.array(linked))], ["a", "b"])


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, content id, words joined by spaces); blank texts have no content id."""
    body = F.trim(F.regexp_replace(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), _SPACE, " "))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), body.alias("_body"))
    return rows.withColumn("c", F.when(F.col("_body") != "", F.unhex(F.md5(F.col("_body").cast("binary")))))


def _hashed(texts: DataFrame, *columns: str) -> DataFrame:
    """The columns and the hashes of the words."""
    words = F.when(F.col("c").isNotNull(), F.split("_body", " ")).otherwise(F.array().cast("array<string>"))
    split = texts.select(*columns, words.alias("_words"))
    return split.select(*columns, F.transform("_words", lambda w: F.xxhash64(w)).alias("words"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("c").alias("a"), F.col("elements").alias("left"))
    right = sets.select(F.col("c").alias("b"), F.col("elements").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(tidy(_compare), "a binary, b binary")


def _own_shingles(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(c, total, own): shingles of each node, and those that no other of the nodes has."""
    each = sets.join(nodes, "c").dropDuplicates(["c"]).select("c", F.explode("elements").alias("element"))
    one = each.groupBy("element").agg(F.count("*").alias("n"), F.first("c").alias("c"))
    own = one.filter("n = 1").groupBy("c").agg(F.count("*").alias("own"))
    total = sets.groupBy("c").agg(F.max(F.size("elements")).alias("total"))
    return nodes.join(total, "c").join(own, "c", "left").select("c", "total", F.coalesce("own", F.lit(0)).alias("own"))


def _may_be_similar(x: Column, y: Column) -> Column:
    """Whether two sets can reach the similarity: what only one of them has is never shared."""
    common = F.least(x["total"] - x["own"], y["total"] - y["own"])
    union = F.greatest(x["total"] + y["own"], y["total"] + x["own"])
    return common >= SIMILARITY * union - 1e-9


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key under its name, ``class_key`` (the smallest key of
    its class), ``class_size`` in rows, ``class_texts`` in different texts and ``kept``, true
    for one row of each class."""
    texts = _texts(docs, key, text)
    rows = _hashed(texts, "key", "c")
    keys = T.StructField("bands", T.ArrayType(T.LongType()))
    sketched = rows.mapInArrow(tidy(_sketch), T.StructType([*rows.schema.fields[:-1], keys]))
    # The written numbers tell rows apart that are equal in key and text.
    sketched = stage(sketched.withColumn("row", F.monotonically_increasing_id()), "sketches")
    first = F.struct(F.col("key").isNull().alias("no_key"), "key", "row")
    contents = sketched.filter("c is not null").groupBy("c")
    contents = stage(contents.agg(F.min(first).alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "contents")
    placed = contents.select("c", F.explode("bands").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = stage(placed.join(sizes, "bucket"), "shared")
    nodes = stage(contents.join(shared.select("c").distinct(), "c").select("c", F.col("first.key").alias("least")), "nodes")

    # Shingle sets of the contents that have candidates, from the row with the smallest key.
    wanted = nodes.select("c", F.col("least").alias("_least"))
    wanted = F.broadcast(wanted) if nodes.count() <= BROADCAST_ROWS else wanted
    asked = _hashed(texts.join(wanted, "c").filter(F.col("key").eqNullSafe(F.col("_least"))), "c")
    elements = T.StructField("elements", T.ArrayType(T.LongType()))
    sets = stage(asked.mapInArrow(tidy(_sets), T.StructType([asked.schema["c"], elements])), "sets")

    found = linked(shared, lambda pairs: _verified(pairs, sets), facts=lambda open_: _own_shingles(sets, open_), bound=_may_be_similar)
    classes = contents.select("c", "first", "copies").join(found.withColumnRenamed("node", "c"), "c", "left")
    classes = stage(classes.select("c", "first", "copies", F.coalesce("root", "c").alias("root")), "classes")
    heads = classes.groupBy("root").agg(
        F.min("first").alias("head"), F.sum("copies").alias("class_size"), F.count("*").alias("class_texts")
    )
    named = classes.join(heads, "root").select("c", "head", "class_size", "class_texts")
    found = sketched.filter("c is not null").select("key", "row", "c").join(named, "c").select(
        "key", F.col("head.key").alias("class_key"), "class_size", "class_texts", (F.col("row") == F.col("head.row")).alias("kept")
    )
    one = F.lit(1).cast("long")
    blank = sketched.filter("c is null").select(
        "key", F.col("key").alias("class_key"), one.alias("class_size"), one.alias("class_texts"), F.lit(True).alias("kept")
    )
    return found.unionByName(blank).withColumnRenamed("key", key)
