import random

import numpy as np
from pyspark.sql import functions as F

from kairoscope import staging
from kairoscope.llm import graph, line_dedup, minhash


def roots(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(n, n + 1) for n in range(200, 260)] + [(300, n) for n in range(301, 340)]
    found = graph.components(spark.createDataFrame(links, "a long, b long"))
    got = {r.node: r.root for r in found.collect()}
    assert got == {x: root for x, root in roots(links).items() if x != root}


def test_linked_finds_every_component(spark):
    """Buckets whose most popular member is not similar to all: no link may be lost."""
    rng = random.Random(10)
    places = {n: rng.randint(0, 400) for n in range(120)}
    buckets = [(n % 3, n, 40) for n in places] + [(10, n, 60) for n in range(60)]
    shared = spark.createDataFrame(buckets, "bucket long, c long, size long")
    near = spark.createDataFrame(list(places.items()), "c long, place long")

    def verify(pairs):
        left, right = (near.select(F.col("c").alias(s), F.col("place").alias(f"p{s}")) for s in "ab")
        return pairs.join(left, "a").join(right, "b").filter(F.abs(F.col("pa") - F.col("pb")) <= 4).select("a", "b")

    got = {r.node: r.root for r in graph.linked(shared, verify).collect()}
    pairs = [(a, b) for a in places for b in places if a < b and abs(places[a] - places[b]) <= 4 and (a % 3 == b % 3 or max(a, b) < 60)]
    assert got == {x: root for x, root in roots(pairs).items() if x != root}


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    elements = rng.integers(1, 2**63, 60, dtype=np.uint64)
    x, y = rng.integers(0, 4, 60).astype(float), rng.integers(0, 4, 60).astype(float)
    want = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(60)) for i in range(60) if x[i] and y[i])
    places = 20_000
    at = [np.flatnonzero(v) for v in (x, y)]
    kept = minhash.signatures(
        np.concatenate([elements[a] for a in at]), np.repeat([0, 1], [len(a) for a in at]), np.concatenate([x[at[0]], y[at[1]]]), 2, places
    )
    assert abs((kept[0] == kept[1]).mean() - want) < 0.015
    assert (kept != 0).all()
    assert (minhash.signatures(np.empty(0, np.uint64), np.empty(0, int), np.empty(0), 1) == 0).all()


def test_near_classes_equal_brute_force(docs):
    rng = random.Random(12)
    vocabulary = [f"w{n}" for n in range(400)]
    base = rng.choices(vocabulary, k=150)
    rows = []
    for n in range(40):  # one large group of near copies with 0 to 6 edits
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(150)] = f"e{rng.random()}"
        rows.append((n, " ".join(words)))
    rows += [(100 + n, " ".join(rng.choices(vocabulary, k=rng.randint(1, 80)))) for n in range(40)]
    rows += [(200, rows[45][1] + "  "), (201, rows[45][1].replace(" ", "\n")), (202, None), (203, ""), (204, " "), (205, "one two"), (206, "one  two"), (None, "null key")]
    sets = {}
    for key, text in rows:
        words = (text or "").split()
        if words:
            sets[key] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    keys = [k for k in sets if k is not None]
    pairs = [(a, b) for a in keys for b in keys if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = roots(pairs)
    got = minhash.near_classes(docs(rows, class_key="clash")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.class_key == want.get(r.doc_id, r.doc_id)
    assert minhash.near_classes(docs([])).collect() == []


def python_simhash(hashes):
    bits = 0
    for n in range(64):
        if 2 * sum(h >> n & 1 for h in hashes) > len(hashes):
            bits |= 1 << n
    return bits - (1 << 64) if bits >> 63 else bits


def test_simhash(spark):
    rng = random.Random(13)
    rows = [(n, [rng.getrandbits(64) - (1 << 63) for _ in range(n)]) for n in (1, 2, 5, 127, 128, 300)] + [(40_000, [-1] * 20_001 + [0] * 19_999)]
    table = spark.createDataFrame(rows, "n int, h array<long>")
    got = {r.n: r.sim for r in line_dedup.simhash(table, "h", "n").collect()}
    assert got == {n: python_simhash([h & (1 << 64) - 1 for h in hashes]) for n, hashes in rows}


def test_blocks_are_pigeonholes(spark):
    rng = random.Random(14)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = []
    for n in range(60):
        value = rng.getrandbits(64)
        other = value
        for bit in rng.sample(range(64), n % 4):
            other ^= 1 << bit
        rows.append((signed(value), signed(other)))
    for blocks in (5, 6, 8):
        table = spark.createDataFrame(rows, "a long, b long").select(*[line_dedup.block_buckets(F.col(c), blocks).alias(c) for c in "ab"])
        assert table.filter(~F.arrays_overlap("a", "b")).count() == 0


def test_fuzzy_lines(docs):
    long = " ".join("".join(chr(97 + int(d)) for d in str(n * n)) for n in range(200))
    rows = [
        (1, "The quick brown fox jumps!\nunique first line of text one"),
        (2, f"{long}\nthe QUICK brown fox, jumps"),
        (3, f"short\n{long} x\n\nshort"),
        (3, f"short\n{long} x\n\nshort"),
        (4, None), (5, ""), (None, "the quick brown fox jumps"),
    ]
    got = sorted(line_dedup.fuzzy_lines(docs(rows, kept="clash")).collect(), key=lambda r: (r.doc_id or 0, r.line_no))
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.line_no), []).append(r)
    assert len(got) == 2 + 2 + 4 + 4 + 1 + 1 + 1
    assert not by[1, 0][0].kept and by[None, 0][0].kept and by[2, 1][0].group_lines == 3  # null keys sort first
    assert by[1, 1][0].kept and sum(r.kept for r in by[3, 0]) == 1 and by[3, 2][0].kept  # one of repeated rows
    assert by[2, 0][0].kept and by[3, 1][0].keep_key == 2 and by[3, 1][0].group_texts == 2 and not by[3, 1][1].kept
    assert line_dedup.fuzzy_lines(docs([])).collect() == []


def test_sketches_hold_little_at_once():
    """10,000 short texts and one long text: a worker holds the signatures of few rows and the shingles of few words."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    lengths = np.append(np.full(10_000, 40), 60_000)
    offsets = np.append(0, np.cumsum(lengths))
    words = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rng.integers(0, 1 << 60, offsets[-1])))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(lengths))), words], ["c", "words"])
    tracemalloc.start()
    rows = sum(out.num_rows for out in minhash._sketch(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(lengths)
    assert peak < 40e6


def test_similar_lines_are_told_by_their_edits(spark):
    """Thinned lines and pieces settle pairs as the edit distance of the whole lines does."""
    rng = random.Random(15)
    letters = "aeinorsth lducmfpg"
    rows = []
    for n in range(400):
        line = "".join(rng.choices(letters, k=rng.randint(1, 90)))
        other = list(line)
        for _ in range(rng.randint(0, len(line) // 3)):
            at = rng.randrange(len(other) + 1)
            other[at : at + rng.randint(0, 1)] = rng.choices(letters, k=rng.randint(0, 1))
        rows.append((line, "".join(other) if n % 4 else "".join(rng.choices(letters, k=len(line)))))
    table = spark.createDataFrame(rows, "x string, y string")
    longer = F.greatest(F.length("x"), F.length("y"))
    want = F.levenshtein("x", "y") <= F.floor(longer * (1 - line_dedup.SIMILARITY) + 1e-9)
    got = table.select(want.alias("want"), line_dedup.similar(F.col("x"), F.col("y")).alias("got")).collect()
    assert all(r.want == r.got for r in got) and 50 < sum(r.want for r in got) < 350


def test_lines_are_written_once(spark, docs, tmp_path, monkeypatch):
    """Lines without a near one are staged in one place only."""
    monkeypatch.setattr(staging, "shared_dir", lambda spark: str(tmp_path))
    rng = random.Random(16)
    rows = [(n, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=2000))) for n in range(300)]
    line_dedup.fuzzy_lines(docs(rows))
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 1.2 * sum(len(text) for _, text in rows)
