"""Ordered windows give the same rows whether or not hot keys are split."""

import random

import pytest
from pyspark.sql import functions as F

from kairoscope.operators import audit, intervals, temporal
from kairoscope.operators.ordered import ordered_groups


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(12)}"
        rows.append((key, float(rng.randrange(200)), i, rng.choice([None, rng.randrange(100)])))
    return spark.createDataFrame(rows, "k string, t double, id int, v int").repartition(5)


def groups_of(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["k"], r["t"], r["id"])):
        out.setdefault(r["k"], []).append(r)
    return out


@pytest.mark.parametrize("limit", [None, 20])
def test_against_loop(log, limit):
    g = ordered_groups(log, ["k"], ["t", "id"], limit)
    assert g.split is (limit is not None)
    w = g.lag(pv="v", pt="t").running_sum("s", "v").max_before("m", "t").last_known("l", "v")
    got = {r["id"]: r for r in w.trailing(4, a=F.sum("id")).result().collect()}
    assert len(got) == 600
    for rows in groups_of(log.collect()).values():
        total, known = None, None
        for i, r in enumerate(rows):
            o = got[r["id"]]
            before = rows[i - 1] if i else None
            assert (o["pv"], o["pt"]) == ((before["v"], before["t"]) if before else (None, None))
            total = total if r["v"] is None else (total or 0) + r["v"]
            assert (o["s"] or 0) == (total or 0)
            assert o["m"] == (max(x["t"] for x in rows[:i]) if i else None)
            known = known if r["v"] is None else r["v"]
            assert o["l"] == known
            assert o["a"] == sum(x["id"] for x in rows[max(0, i - 3) : i + 1])


def test_no_hot_key_plans_one_shuffle(log):
    plan = ordered_groups(log, ["k"], ["t", "id"]).lag(pv="v").result()._jdf.queryExecution().toString()
    assert "RepartitionByExpression" not in plan


@pytest.mark.parametrize("limit", [None, 10])
def test_interval_union_and_gaps(spark, limit):
    rng = random.Random(3)
    cached, asked = [], []
    for v in ("a", "b", "c"):
        for _ in range(60 if v == "a" else 8):
            s = rng.randrange(0, 400)
            cached.append((v, float(s), float(s + rng.choice([0, 1, 3, 9]))))
        for i in range(15):
            s = rng.randrange(-20, 420)
            asked.append((f"{v}{i}", v, float(s), float(s + rng.randrange(1, 60))))
    asked.append(("none", "zzz", 0.0, 5.0))
    iv = spark.createDataFrame(cached, "video_id string, start double, end double")
    req = spark.createDataFrame(asked, "request_id string, video_id string, start double, end double")
    islands = intervals.merge_intervals(iv, ["video_id"], limit=limit)

    want = {}
    for v, s, e in sorted(cached):
        runs = want.setdefault(v, [])
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    got = sorted((r["video_id"], r["start"], r["end"]) for r in islands.collect())
    assert got == sorted((v, s, e) for v, runs in want.items() for s, e in runs)
    assert islands.agg(F.sum("n_intervals")).first()[0] == len(cached)

    expected = []
    for rid, v, s, e in asked:
        at = s
        for lo, hi in want.get(v, []):
            if hi < s or lo > e:
                continue
            if lo > at:
                expected.append((rid, at, lo))
            at = max(at, hi)
        if at < e:
            expected.append((rid, at, e))
    gaps = intervals.coverage_gaps(islands, req, ["video_id"], limit=limit)
    assert sorted((r["request_id"], r["gap_start"], r["gap_end"]) for r in gaps.collect()) == sorted(expected)


@pytest.mark.parametrize(
    "cached, request_, want",
    [
        ([(0, 5), (10, 15)], (0, 15), [(5, 10)]),
        ([(2, 5)], (0, 5), [(0, 2)]),
        ([(0, 2)], (0, 5), [(2, 5)]),
        ([(0, 9), (2, 3)], (1, 8), []),
        ([(0, 2), (2, 5)], (0, 5), []),
        ([], (0, 5), [(0, 5)]),
        ([(0, 5)], (0, 5), []),
        ([(1, 2), (3, 4)], (0, 5), [(0, 1), (2, 3), (4, 5)]),
    ],
)
def test_gap_cases(spark, cached, request_, want):
    iv = spark.createDataFrame([("v", float(a), float(b)) for a, b in cached], "video_id string, start double, end double")
    req = spark.createDataFrame([("r", "v", float(request_[0]), float(request_[1]))], "request_id string, video_id string, start double, end double")
    gaps = intervals.coverage_gaps(intervals.merge_intervals(iv, ["video_id"]), req, ["video_id"])
    assert sorted((r["gap_start"], r["gap_end"]) for r in gaps.collect()) == want


@pytest.mark.parametrize("limit", [None, 25])
def test_point_in_island(spark, log, limit):
    islands = spark.createDataFrame([("hot", 10.0, 50.0), ("hot", 60.0, 60.0), ("k1", 0.0, 199.0)], "k string, start double, end double")
    out = intervals.covering_island(log, islands, ["k"], "t", "id", limit)
    for r in out.collect():
        inside = {"hot": [(10, 50), (60, 60)], "k1": [(0, 199)]}.get(r["k"], [])
        assert r["covered"] == any(a <= r["t"] <= b for a, b in inside)
    assert out.count() == 600


@pytest.mark.parametrize("limit", [None, 20])
def test_dedup_rules(spark, limit):
    rng = random.Random(11)
    rows = [("hot" if i % 3 else f"v{i % 5}", i, rng.randrange(-(2**63), 2**63) if rng.random() < 0.2 else 5) for i in range(300)]
    for i in range(1, 300):  # drift, so that greedy and adjacent differ
        if rng.random() < 0.7:
            rows[i] = (rows[i][0], i, rows[i - 1][2] ^ (1 << rng.randrange(62)))
    df = spark.createDataFrame(rows, "video_id string, frame_id long, phash long")

    def distance(a, b):
        return ((a ^ b) & (2**64 - 1)).bit_count()

    greedy, adjacent = {}, {}
    for v in {r[0] for r in rows}:
        last = before = None
        for _, f, h in [r for r in rows if r[0] == v]:
            greedy[f] = last is None or distance(h, last) > 5
            last = h if greedy[f] else last
            adjacent[f] = before is None or distance(h, before) > 5
            before = h
    assert greedy != adjacent
    got = {r["frame_id"]: r["kept"] for r in temporal.dedup_greedy(df, ["frame_id"], 5, limit).collect()}
    assert got == greedy
    got = {r["frame_id"]: r["kept"] for r in temporal.dedup_adjacent(df, ["frame_id"], 5, limit).collect()}
    assert got == adjacent


def test_greedy_entry_crosses_many_runs(spark):
    # No frame after the first is far enough, so the entry must travel through every run.
    rows = [("v", i, 1 << (i % 3)) for i in range(90)]
    df = spark.createDataFrame(rows, "video_id string, frame_id long, phash long")
    kept = [r["frame_id"] for r in temporal.dedup_greedy(df, ["frame_id"], 5, 8).filter("kept").collect()]
    assert kept == [0]


@pytest.mark.parametrize("limit", [None, 15])
def test_exact_percentile(spark, log, limit):
    import numpy as np

    got = {r["k"]: r["p"] for r in audit.exact_percentile(log, ["k"], "v", 0.95, "p", limit).collect()}
    for k, rows in groups_of(log.collect()).items():
        v = [r["v"] for r in rows if r["v"] is not None]
        assert got[k] == pytest.approx(np.percentile(v, 95))


@pytest.mark.parametrize("limit", [None, 20])
def test_rolling_speed(spark, log, limit):
    out = temporal.upload_speed(log.withColumn("b", F.lit(10)), ["k"], "t", "b", 8.0, 3, limit)
    cells = {}
    for k, rows in groups_of(log.collect()).items():
        per = {}
        for r in rows:
            top, n = per.get(int(r["t"] // 8), (0, 0))
            per[int(r["t"] // 8)] = (max(top, r["t"]), n + 10)
        rates, last = [], None
        for c in sorted(per):
            at, size = per[c]
            rates.append(size / (at - last) if last is not None and at > last else None)
            last = at
            recent = [x for x in rates[-3:] if x is not None]
            cells[k, c] = sum(recent) / len(recent) if recent else None
    got = {(r["k"], r["cell"]): r["speed"] for r in out.collect()}
    assert got.keys() == cells.keys()
    for key, want in cells.items():
        assert got[key] == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize("limit", [None, 20])
def test_transitions(spark, limit):
    states = ["queued", "running", "running", "completed", "running", "cancelling", "cancelled"]
    rows = [("j", i, s) for i, s in enumerate(states)] + [("x", 0, "running")]
    rows += [("big", i, "queued" if i % 40 == 0 else "running") for i in range(120)]
    df = spark.createDataFrame(rows, "job_id string, ts long, status string")
    got = temporal.validate_transitions(df, ["ts"], limit)
    flags = [r["allowed"] for r in got.filter("job_id = 'j'").orderBy("ts").collect()]
    assert flags == [True, True, True, True, False, True, True]
    assert got.filter("job_id = 'x'").first()["allowed"] is False
    assert got.filter("job_id = 'big' and not allowed").count() == 2


def test_a_huge_request_looks_into_few_nodes(spark):
    """Nodes hold exactly the slots of a range; a request of a million slots takes fewer than a hundred."""
    ranges = [(0, 0), (5, 5), (-3, 4), (-9, -2), (7, 8), (1, 1_000_000), (-1_000_000, 999_999), (3, 2**40), (4, 3)]
    df = spark.createDataFrame(ranges, "a long, b long")
    for row in df.withColumn("nodes", intervals.time_nodes(F.col("a"), F.col("b"))).collect():
        assert len(row.nodes) < 100
        spans = sorted((n.node << n.level, (n.node + 1 << n.level) - 1) for n in row.nodes)
        assert not spans if row.a > row.b else (spans[0][0], spans[-1][1]) == (row.a, row.b)
        assert all(left[1] + 1 == right[0] for left, right in zip(spans, spans[1:]))


def test_gaps_of_requests_of_very_unlike_lengths(spark):
    cached = [("v", 10.0 * i, 10.0 * i + 5) for i in range(-20, 400)]
    asked = [("v", f"r{i}", float(i), float(i) + 1) for i in range(0, 60, 7)] + [("v", "huge", -1e6, 1e6), ("v", "none", 5.0, 5.0)]
    islands = spark.createDataFrame(cached, "video_id string, start double, end double")
    requests = spark.createDataFrame(asked, "video_id string, request_id string, start double, end double")
    got = sorted((r.request_id, r.gap_start, r.gap_end) for r in intervals.coverage_gaps(islands, requests, ["video_id"], slot_s=1.0).collect())
    want = []
    for _, name, low, high in asked:
        at = low
        for _, a, b in cached:
            if b >= low and a <= high:
                want += [(name, at, min(a, high))] if a > at else []
                at = max(at, b)
        want += [(name, at, high)] if high > at else []
    assert got == sorted(want)


def test_window_sketches_merge_to_the_whole(spark):
    """Merged windows stay within a percent of the rank, whatever the cut into windows."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"),
        F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.pmod(F.col("id") * 7919, F.lit(20_000)).cast("double").alias("v"),
    ).unionByName(spark.createDataFrame([("a", None, 5.0), ("b", None, None)], "k string, ts timestamp, v double"))
    exact = {r["k"]: r["p"] for r in audit.exact_percentile(rows.filter("ts is not null"), ["k"], "v", 0.95, "p").collect()}
    for window in ("10 minutes", "2 days"):
        sketches = audit.latency_sketches(rows, ["k"], "ts", "v", window)
        got = {r["k"]: r for r in audit.merged_latency(sketches, ["k"]).collect()}
        assert {k: r["count"] for k, r in got.items()} == {"a": 6667, "b": 13333}
        assert all(abs(got[k]["p95"] - exact[k]) <= 200 for k in exact)
    assert audit.merged_latency(sketches.filter("false"), ["k"]).count() == 0
