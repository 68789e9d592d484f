"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled texts.
A text is compressed with either, in blocks so that the dictionaries stay in reach in
long texts. The difference of the two sizes over their sum is near +1 for text that
only the good dictionary explains and near -1 for the opposite; together with the
compressed share of the text it goes through a logistic calibration fitted on
labelled texts that the dictionaries have not seen. Nothing but the text enters a score.

The model is fitted on a bounded sample, ``SAMPLE_ROWS`` labelled documents per class
and half and ``SAMPLE_BYTES`` of text per class and half, taken in the order of a hash
of their keys. Texts come whole; one that would exceed the bytes is passed over.
Scoring covers every document where it is read, without a shuffle.

A null text counts as empty; empty texts are scored like others. Null labels, null
keys and contradicting labels are left out of the sample. Without texts of both classes
nothing can be told apart and every score is 1. Repeated rows get equal scores; very long
texts are compressed whole, block by block; an empty table gives no rows. Result columns
replace columns of the same name, other columns are passed through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import free_name
from .workers import tidy

SAMPLE_ROWS = 4000
SAMPLE_BYTES = 6 << 20
DICTIONARY_BYTES = 112_640
LEVEL = 3
BLOCK_BYTES = 2048
#: Texts are handled in groups of about so many bytes, whatever the batch holds.
GROUP_BYTES = 2 << 20
#: Added to sizes, so that a few bytes of text say little.
SLACK = 16.0
THRESHOLD = 0.7


def remainder(key: str = "doc_id") -> Column:
    """The fold of a document: the CRC-32 of its key as text, modulo 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4, F.lit(0))


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


class Sizes:
    """Compressed sizes of texts under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        make = lambda d: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **options)
        self.good, self.bad = make(good), make(bad)

    def of(self, text: str | None) -> tuple[int, int, int]:
        data = (text or "").encode()
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, max(1, len(data)), BLOCK_BYTES)]
        return len(data), sum(len(self.good.compress(b)) for b in blocks), sum(len(self.bad.compress(b)) for b in blocks)


def features(sizes: np.ndarray) -> np.ndarray:
    raw, good, bad = sizes.reshape(-1, 3).T.astype(float)
    difference = (bad - good) / (bad + good + SLACK)
    share = bad / (raw + SLACK)
    return np.stack([np.ones_like(raw), difference, share, share * share], 1)


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights of a logistic regression, by Newton steps."""
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale[scale == 0] = 0.0, 1.0
    z = (x - mean) / scale
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, w


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str) -> dict[tuple[int, int], list[str]]:
    """Texts by (class, half), whole and within the bounds."""
    known = labels.filter(F.col(key).isNotNull() & F.col("quality").isin(0, 1)).select(F.col(key).alias("_key"), "quality")
    drawn = None
    for value in (0, 1):
        part = known.filter(F.col("quality") == value).orderBy(F.xxhash64("_key"), "_key").limit(2 * SAMPLE_ROWS)
        drawn = part if drawn is None else drawn.unionByName(part)
    drawn = drawn.groupBy("_key").agg(F.min("quality").alias("quality"), F.max("quality").alias("_other"))
    drawn = drawn.filter("quality = _other").drop("_other")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    found = docs.select(F.col(key).alias("_key"), body.alias("_text")).join(F.broadcast(drawn), "_key")
    half = F.pmod(F.xxhash64("_key", F.lit("half")), F.lit(2)).cast("int")
    sized = found.groupBy("_key").agg(F.min("quality").alias("quality"), F.max(F.octet_length("_text")).alias("bytes"))
    chosen, used = [], {}
    for row in sized.withColumn("half", half).orderBy(F.xxhash64("_key"), "_key").collect():
        place = row.quality, row.half
        if used.get(place, 0) + row.bytes <= SAMPLE_BYTES:
            used[place] = used.get(place, 0) + row.bytes
            chosen.append((row._key, row.half))
    texts: dict[tuple[int, int], list[str]] = {}
    if chosen:
        # From Arrow: rows of Python objects would start workers of a second kind on the executors.
        keys, halves = zip(*chosen, strict=True)
        wanted = docs.sparkSession.createDataFrame(pa.table({"_key": pa.array(keys, pa.int64()), "half": pa.array(halves, pa.int32())}))
        rows = found.join(F.broadcast(wanted), "_key").groupBy("_key", "quality", "half").agg(F.max("_text").alias("_text"))
        for row in rows.orderBy(F.xxhash64("_key"), "_key").toLocalIterator():
            texts.setdefault((row.quality, row.half), []).append(row._text)
    return texts


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model | None:
    """Dictionaries from one half of the sample, calibration on the other.

    ``labels`` holds only the rows that may be learnt from. None if a class is missing.
    """
    texts = _sample(docs, labels, key, text)
    if any(not texts.get((value, half)) for value in (0, 1) for half in (0, 1)):
        return None
    built = []
    for value in (1, 0):
        parts = [t.encode()[i : i + BLOCK_BYTES] for t in texts[value, 0] for i in range(0, len(t.encode()), BLOCK_BYTES)]
        try:
            built.append(zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes())
        except zstandard.ZstdError:  # too little text for training: the text itself is the dictionary
            built.append(b"".join(parts)[-DICTIONARY_BYTES:] or b"\0" * 8)
    sizes = Sizes(*built)
    x = features(np.array([sizes.of(t) for value in (0, 1) for t in texts[value, 1]]))
    y = np.array([value for value in (0, 1) for _ in texts[value, 1]], float)
    return Model(*built, *calibrate(x, y))


def _groups(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts with about ``GROUP_BYTES`` together."""
    upto = np.cumsum(lengths) // GROUP_BYTES
    starts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(lengths)]
    return zip(starts[:-1], starts[1:], strict=True)


def score(docs: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with the score (0 to 1) and the prediction, under ``names``.

    A text crosses to Python once and goes back as it came; the batch is cut by bytes,
    so only a few texts are Python strings at a time.
    """
    taken = {n.lower() for n in names}
    kept = [c for c in docs.columns if c.lower() not in taken]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    own = text in kept and isinstance(docs.schema[text].dataType, T.StringType)
    if not own:
        source = docs.select(*source.columns, F.col(f"`{text}`").cast("string").alias(free_name("body", kept)))
    place = kept.index(text) if own else len(kept)
    schema = T.StructType([*source.schema.fields[: len(kept)], T.StructField(names[0], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad)
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
            for low, high in _groups(lengths):
                part = batch.slice(low, high - low)
                rows = [sizes.of(x) for x in part.column(place).to_pylist()]
                z = (features(np.array(rows, dtype=np.int64)) - model.mean) / model.scale
                found = 1 / (1 + np.exp(-np.clip(z @ model.weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(found, pa.float64())], schema.names)

    scored = source.mapInArrow(tidy(run), schema) if model else source.select(*[F.col(f"`{c}`") for c in kept]).withColumn(names[0], F.lit(1.0))
    return scored.withColumn(names[1], (F.col(names[0]) >= THRESHOLD).cast("int"))
