"""Vector arithmetic and the deterministic (non-semantic) text embedding."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Runs of letters and digits of any script.
WORDS = re.compile(r"[^\W_]+")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 when either side has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


@F.arrow_udf(T.DoubleType())
def cosine_pairs(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cosine of two vector columns, one Arrow batch at a time; null if either is null."""
    both = np.logical_and(a.is_valid().to_numpy(False), b.is_valid().to_numpy(False))
    out = np.zeros(len(a))
    if both.any():
        rows = pa.array(both)
        x, y = (v.filter(rows).flatten().to_numpy(False).astype(np.float64).reshape(both.sum(), -1) for v in (a, b))
        size = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
        products = (x * y).sum(axis=1)
        out[both] = np.divide(products, size, out=np.zeros_like(products), where=size > 0)
    return pa.array(out, mask=~both)


def shift_score(raw: Column) -> Column:
    """Map a cosine to 0..1 without looking at other rows."""
    return (raw + 1.0) / 2.0


class _WordCodes(dict):
    """Word -> bucket, plus ``dim`` for a negative sign; filled on demand and bounded."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        digest = hashlib.md5(word.encode()).digest()
        negative = (digest[4] >> 4) % 2
        code = self[word] = int.from_bytes(digest[:4], "big") % self.dim + self.dim * negative
        return code


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Hashed bag of words of the whole text as a unit vector (zeros without words).

    The first 32 bits of a lower-cased word's MD5 pick the bucket, the next hex
    digit the sign. An Arrow UDF with a word cache: no word is exploded into a row
    and nothing is shuffled.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pa.Array) -> pa.Array:
        codes = _WordCodes(dim)
        sums = np.zeros((len(texts), dim))
        for row, words in enumerate(texts):
            found = list(map(codes.__getitem__, WORDS.findall(words.as_py() or "")))
            if found:
                counts = np.bincount(found, minlength=2 * dim)
                sums[row] = counts[:dim] - counts[dim:]
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        unit = np.divide(sums, size, out=np.zeros_like(sums), where=size > 0)
        offsets = pa.array(np.arange(0, (len(texts) + 1) * dim, dim, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))

    return embed(F.lower(text))


def embed_text(df: DataFrame, text: str, dim: int = 64) -> DataFrame:
    """Add ``embedding`` of a text column with the deterministic (non-semantic) backend."""
    return df.withColumn("embedding", hash_embedding(F.col(text), dim))


def mean_vector(df: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Component-wise mean per key, partially aggregated before the shuffle."""
    flat = df.select(*keys, F.posexplode(vector).alias("_i", "_x"))
    means = flat.groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    packed = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_p"))
    return packed.select(*keys, F.transform("_p", lambda e: e["_x"]).alias(vector))
