"""Near frames equal brute force, with buckets that must be cut several times."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairoscope.operators.near_frames import bands, hash_classes, near_frames, near_hashes


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def brute(rows, distance):
    out = {}
    for i, h in rows:
        if h is None:
            continue
        others = [(j, g) for j, g in rows if g is not None and j != i and ((g ^ h) & (2**64 - 1)).bit_count() <= distance]
        same = [j for j, g in rows if g == h]
        out[i] = (h, min(same), len(same), len({g for _, g in others if g != h}), len(others))
    return out


def hashes(kind):
    rng = np.random.default_rng(3)
    if kind == "random":
        base = [int(x) for x in rng.integers(0, 2**63, 60)]
        flips = [[1 << int(b) for b in rng.choice(64, int(rng.integers(0, 8)), replace=False)] for _ in range(240)]
        return [base[i % 60] ^ sum(f) for i, f in enumerate(flips)]
    if kind == "dense":  # ten low bits vary, all others agree: every first band is hot
        return [0x5A5A << 40 | int(x) for x in rng.choice(1024, 300, replace=False)]
    return [int(x) for x in rng.integers(0, 6, 300)]  # a few hashes, many copies


@pytest.mark.parametrize("kind", ["random", "dense", "copies"])
@pytest.mark.parametrize("distance", [0, 2, 5])
def test_equals_brute_force(spark, kind, distance):
    rows = [(f"f{i:03d}", signed(h)) for i, h in enumerate(hashes(kind))] + [("x", None)]
    frames = spark.createDataFrame(rows, "frame_id string, phash long")
    got = {r[0]: tuple(r)[1:] for r in near_frames(frames, distance=distance, limit=8).collect()}
    assert got == brute(rows, distance)


def test_pairs_come_once_and_limit_changes_nothing(spark):
    rows = [(f"f{i}", signed(h)) for i, h in enumerate(hashes("dense"))]
    classes = hash_classes(spark.createDataFrame(rows, "frame_id string, phash long"))
    few = [tuple(r) for r in near_hashes(classes, 3, limit=4).collect()]
    assert len(few) == len(set(few)) and all(a < b for a, b in few)
    assert set(few) == {tuple(r) for r in near_hashes(classes, 3, limit=10_000).collect()}


def test_bands_share_out_the_varying_bits(spark):
    vary = signed(0x8000_0000_0000_F0F3)
    got = spark.range(1).select(bands(F.lit(vary).cast("long"), 2).alias("m")).first()["m"]
    masks = [m & (2**64 - 1) for m in got]
    assert sum(masks) == vary & (2**64 - 1) and sorted(m.bit_count() for m in masks) == [3, 4, 4]


def test_empty_and_negative_distance(spark):
    empty = spark.createDataFrame([], "frame_id string, phash long")
    assert near_frames(empty).count() == 0
    with pytest.raises(ValueError):
        near_hashes(hash_classes(empty), -1)


def test_links_are_counted_and_not_written(spark, monkeypatch):
    """Of 1,000 hashes over 12 bits most pairs are near; no table of them is made."""
    from kairoscope.operators import near_frames as module

    rng = np.random.default_rng(5)
    rows = [(f"f{i:04d}", int(x)) for i, x in enumerate(rng.choice(4096, 1000, replace=False))]
    written, stage = [], module.stage

    def counted(df, name):
        out = stage(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(module, "stage", counted)
    frames = spark.createDataFrame(rows, "frame_id string, phash long")
    got = {r[0]: tuple(r)[1:] for r in near_frames(frames, distance=5, limit=100).collect()}
    assert got == brute(rows, 5) and sum(r[-1] for r in got.values()) > 100_000
    assert max(written) <= len(rows)


@pytest.mark.parametrize("limit", [4, 50, 10_000])
def test_counts_equal_pairs_in_bands_and_blocks(spark, limit):
    from kairoscope.operators.near_frames import near_counts

    rows = [(f"f{i}", signed(h)) for i, h in enumerate(hashes("random") + hashes("dense"))]
    classes = hash_classes(spark.createDataFrame(rows, "frame_id string, phash long")).cache()
    want: dict = {}
    for a, b in near_hashes(classes, 3).collect():
        for h in (a, b):
            want[h] = want.get(h, 0) + 1
    assert {r["hash"]: r["near_classes"] for r in near_counts(classes, 3, limit).collect()} == want
