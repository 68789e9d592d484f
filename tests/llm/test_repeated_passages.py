"""Near copies that repeat a passage are found by the similarity of their shingle sets."""

import random

import numpy as np

from kairoscope.llm import minhash


def test_repeated_passage_is_near(docs):
    rng = random.Random(21)
    rows, want = [], {}
    for n in range(12):
        words = [f"w{rng.random()}" for _ in range(200)]
        footer = " ".join(f"f{n}x{i}" for i in range(10))
        rows += [(n, " ".join([*words, footer])), (100 + n, " ".join([*words, *[footer] * 100]))]
        want |= {n: n, 100 + n: n}
    # Two texts of other words share the repeated footer only.
    rows += [(200 + n, " ".join([*(f"v{n}y{i}" for i in range(200)), *["all rights reserved by the owner"] * 100])) for n in range(2)]
    want |= {200: 200, 201: 201}
    assert {r.doc_id: r.class_key for r in minhash.near_classes(docs(rows)).collect()} == want


def test_bands_without_repeats_are_one_signature():
    rng = np.random.default_rng(4)
    hashed = rng.integers(1, 2**63, 60, dtype=np.uint64)
    count = np.ones(60, np.int64)
    doc = np.repeat([0, 2, 3], 20)
    count[25] = 50  # document 2; document 1 is empty
    keys, bounds = minhash.bands(hashed, doc, count, 4)
    sizes = np.diff(bounds)
    assert sizes[0] == sizes[1] == sizes[3] == minhash.BANDS < sizes[2] <= 2 * minhash.BANDS
    alone = minhash.band_keys(minhash.signatures(hashed[20:40], np.zeros(20, int), np.ones(20), 1))
    assert set(alone[0]) <= set(keys[bounds[2] : bounds[3]])
