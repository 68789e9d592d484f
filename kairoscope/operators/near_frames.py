"""Near duplicates among perceptual hashes by multi-index hashing, across items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .skew import attach_group_values

LIMIT = 256  # distinct hashes that are compared with each other in one bucket
BLOCK = 16_384  # distinct hashes of a block, two of which are compared at a time when links are counted
WIDE = 6  # bits a band has at least for a large bucket to be cut into bands and not into blocks
COMPARED = 200_000_000  # comparisons that a task of the count should make
MOVED = 2_000_000  # hashes that a task of the count should receive
CHUNK = 1 << 19  # comparisons held at once within a task


def hash_classes(frames: DataFrame, id_col: str = "frame_id", hash_col: str = "phash") -> DataFrame:
    """Equal hashes once: ``hash``, the smallest id ``first_id`` and the number of ``copies``.

    Frames without a hash have no class.
    """
    return (
        frames.filter(F.col(hash_col).isNotNull())
        .groupBy(F.col(hash_col).cast("long").alias("hash"))
        .agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("copies"))
    )


def bands(vary: Column, distance: int) -> Column:
    """The set bits of ``vary`` dealt to ``distance + 1`` masks.

    Hashes that differ in at most ``distance`` of these bits agree on one mask whole.
    """
    positions = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda bit: F.getbit(vary, bit) == 1)
    dealt = lambda part: F.filter(positions, lambda _, i: F.pmod(i, F.lit(distance + 1)) == part)
    add = lambda mask, bit: mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    masks = [F.aggregate(dealt(part), F.lit(0).cast("long"), add) for part in range(distance + 1)]
    return F.array(*masks)


def near_hashes(classes: DataFrame, distance: int = 5, limit: int = LIMIT) -> DataFrame:
    """Every pair ``a < b`` of distinct 64-bit hashes that differ in at most ``distance`` bits, once.

    ``classes`` has one row per ``hash``. Hashes meet in buckets of equal bits under a mask.
    A bucket of more than ``limit`` hashes is not joined: the bits that vary in it are cut into
    bands, one of which any near pair agrees on, and each band makes smaller buckets. Where no
    more than ``distance`` bits vary all members are near. So no pair is lost, and a hash is
    compared with ``max(limit, 2 ** distance)`` others of a bucket at most. Sizes and varying
    bits are aggregated partially; no bucket is gathered before it is known to be small.
    """
    if not 0 <= distance < 64:
        raise ValueError("distance must lie between 0 and 63")
    nothing = F.lit(0).cast("long")
    keyed = stage(classes.select("hash", nothing.alias("mask"), nothing.alias("value")), "hashes")
    found: list[DataFrame] = []
    while True:
        differ = F.bit_or("hash").bitwiseXOR(F.bit_and("hash"))
        buckets = keyed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n"), differ.alias("vary"))
        held = attach_group_values(keyed, buckets.filter(F.col("n") > 1), ["mask", "value"], "n", "hash")
        hot = (F.col("n") > limit) & (F.bit_count("vary") > distance)
        held = stage(held.withColumn("hot", hot), "buckets")
        small = held.filter(~F.col("hot")).select("mask", "value", F.col("hash").alias("a"))
        pairs = small.join(small.withColumnRenamed("a", "b"), ["mask", "value"])
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
        found.append(pairs.filter((F.col("a") < F.col("b")) & near).select("a", "b"))
        split = held.filter("hot")
        if split.isEmpty():
            break
        # Bits that do not vary are fixed already, so buckets of one parent stay together.
        cut = split.select("hash", "vary", F.explode(bands(F.col("vary"), distance)).alias("band"))
        mask = F.bitwise_not("vary").bitwiseOR(F.col("band"))
        cut = cut.select("hash", mask.alias("mask"), F.col("hash").bitwiseAND(mask).alias("value"))
        keyed = stage(cut.distinct(), "hashes")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.distinct()


def _count_near(distance: int):
    """Counts of links between two blocks of hashes, or within one where ``right`` is null.

    A link counts in the first bucket only where its hashes meet: there they differ in each of
    the ``earlier`` bands.
    """

    def near(a: np.ndarray, b: np.ndarray, earlier: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        vary = np.bitwise_or.reduce(a ^ a[0]) | np.bitwise_or.reduce(b ^ a[0])
        if vary < 1 << 32:  # bits that do not vary are not needed, and half as wide is faster
            a, b, earlier = ((x & vary).astype(np.uint32) for x in (a, b, earlier))
        step = max(1, CHUNK // len(b))
        for low in range(0, len(a), step):
            differ = a[low : low + step, None] ^ b[None, :]
            at = np.flatnonzero(np.bitwise_count(differ) <= distance)
            if len(earlier):
                bits = differ.ravel()[at]
                at = at[np.logical_and.reduce([(bits & band) != 0 for band in earlier])]
            r, s = np.divmod(at, len(b))
            yield r + low, s

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            for n in range(batch.num_rows):
                earlier, left, left_copies, right, right_copies = (
                    None if not c[n].is_valid else c[n].values.to_numpy(zero_copy_only=False) for c in batch.columns
                )
                a, earlier = left.view(np.uint64), earlier.view(np.uint64)
                within = right is None
                b, other = (a, left_copies) if within else (right.view(np.uint64), right_copies)
                found = np.zeros((2, len(a)), np.int64), np.zeros((2, len(b)), np.int64)
                for r, s in near(a, b, earlier):
                    if within:
                        r, s = r[r != s], s[r != s]
                    found[0][0] += np.bincount(r, minlength=len(a))
                    found[0][1] += np.bincount(r, other[s], len(a)).astype(np.int64)
                    if not within:
                        found[1][0] += np.bincount(s, minlength=len(b))
                        found[1][1] += np.bincount(s, left_copies[r], len(b)).astype(np.int64)
                for hashes, (classes, frames) in zip((left, right), found[: 1 if within else 2]):
                    some = classes > 0
                    parts.append((hashes[some], classes[some], frames[some]))
            if parts:
                arrays = [pa.array(np.concatenate(c)) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays(arrays, ["hash", "near_classes", "near"])

    return count


def near_counts(classes: DataFrame, distance: int = 5, limit: int = BLOCK) -> DataFrame:
    """``near_classes`` and ``near``, the classes and frames linked with each ``hash`` that has a link.

    The links are those of :func:`near_hashes`, but none is written or shuffled: of dense hashes there
    are too many. Buckets of more than ``limit`` hashes are cut into bands as there while a band
    is ``WIDE`` bits at least. Narrower bands leave most pairs in some bucket and would only multiply
    the rows; such buckets are dealt into blocks of about ``limit`` hashes, two of which a task compares at
    a time. A task holds two blocks and sends one count per hash of them. ``classes`` has one row per
    ``hash`` with its ``copies``.
    """
    if not 0 <= distance < 64:
        raise ValueError("distance must lie between 0 and 63")
    nothing = F.lit(0).cast("long")
    none = F.array().cast("array<bigint>")
    keys = ["path", "mask", "value"]
    # Bands met on the way to a bucket tell apart those of equal bits, which hold the same pairs.
    keyed = classes.select("hash", "copies", F.lit("").alias("path"), nothing.alias("mask"), nothing.alias("value"), none.alias("earlier"))
    keyed = stage(keyed, "hashes")
    small = None
    while True:
        differ = F.bit_or("hash").bitwiseXOR(F.bit_and("hash"))
        buckets = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), differ.alias("vary")).filter("n > 1")
        hot = (F.col("n") > limit) & (F.bit_count("vary") >= WIDE * (distance + 1))
        buckets = buckets.withColumn("bands", F.when(hot, bands(F.col("vary"), distance)))
        held = stage(attach_group_values(keyed, buckets, keys, "n", "hash"), "buckets")
        whole = held.filter("bands is null").select("hash", "copies", *keys, "earlier", "n")
        small = whole if small is None else small.unionByName(whole)
        split = held.filter("bands is not null")
        if split.isEmpty():
            break
        cut = split.select("*", F.posexplode("bands").alias("k", "band"))
        mask = F.bitwise_not("vary").bitwiseOR(F.col("band"))
        cut = cut.select(
            "hash", "copies", F.concat_ws(".", "path", "k").alias("path"), mask.alias("mask"), F.col("hash").bitwiseAND(mask).alias("value"),
            F.concat("earlier", F.slice("bands", F.lit(1), F.col("k"))).alias("earlier"),
        )
        keyed = stage(cut, "hashes")

    dealt = small.withColumn("blocks", F.ceil(F.col("n") / limit)).withColumn("block", F.pmod(F.xxhash64("hash"), F.col("blocks")))
    members = F.collect_list(F.struct("hash", "copies"))
    dealt = dealt.groupBy(*keys, "block", "blocks", "n").agg(F.first("earlier").alias("earlier"), members.alias("members"))
    dealt = stage(dealt.withColumn("size", F.size("members").cast("long")), "blocks")
    work = dealt.agg(F.sum(F.col("size") * F.col("n")).alias("pairs"), F.sum(F.col("size") * F.col("blocks")).alias("moved")).first()
    tasks = max(1, -(-(work["pairs"] or 0) // (2 * COMPARED)), -(-(work["moved"] or 0) // MOVED))
    place = [*keys, "i", "j"]
    values = lambda side: [F.col(f"members.{c}").alias(f"{side}_{c}") for c in ("hash", "copies")]
    left = dealt.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence("block", F.col("blocks") - 1)))
    left = left.select(*place, "earlier", *values("left")).repartition(tasks, *place)
    right = dealt.filter("block > 0").withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block") - 1)))
    right = right.select(*place, *values("right")).repartition(tasks, *place)
    # A block may be empty: it is no reason to take the other one of a pair by itself once more.
    both = left.hint("merge").join(right, place, "left").filter("i = j or right_hash is not null")
    both = both.select("earlier", "left_hash", "left_copies", "right_hash", "right_copies")
    partial = both.mapInArrow(_count_near(distance), "hash long, near_classes long, near long")
    return partial.groupBy("hash").agg(F.sum("near_classes").alias("near_classes"), F.sum("near").alias("near"))


def near_frames(
    frames: DataFrame, id_col: str = "frame_id", hash_col: str = "phash", distance: int = 5, limit: int = BLOCK
) -> DataFrame:
    """Each hashed frame with its class of equal hashes and the number of near frames.

    ``first_id`` and ``copies`` name the class, ``near_classes`` counts the other classes within
    ``distance`` bits and ``n_near`` the frames of both, without the frame itself. The counts are
    those of :func:`near_counts`; copies are counted, not paired.
    """
    classes = stage(hash_classes(frames, id_col, hash_col), "classes")
    counted = near_counts(classes, distance, limit).withColumnRenamed("near", "_near")
    values = classes.join(counted, "hash", "left").select(
        "hash", "first_id", "copies", F.coalesce("near_classes", F.lit(0)).alias("near_classes"),
        (F.coalesce("_near", F.lit(0)) + F.col("copies") - 1).alias("n_near"),
    )
    hashed = frames.filter(F.col(hash_col).isNotNull()).select(id_col, F.col(hash_col).cast("long").alias("hash"))
    # The counts feed a join and its broadcast side.
    values = stage(values, "counts")
    return attach_group_values(hashed, values, ["hash"], "copies", id_col).withColumnRenamed("hash", hash_col)
