"""Collocations, conversation trie and fingerprints against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairoscope.llm import collocations, conversation_trie, fingerprint, queries

TRIE_COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
TALK = "conv_id long, turn long, role string, text string"
PHRASE_COLUMNS = "lang rank phrase a l r n score".split()


# --- phrase collocations ----------------------------------------------------------


def brute_phrases(rows, top):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, found in counts.items():
        candidates = {q: a for q, a in found.items() if len(q) > 1 and a >= 100}
        dropped = set()
        for q, a in candidates.items():
            for k in range(2, len(q)):
                dropped |= {q[i : i + k] for i in range(len(q) - k + 1) if 100 * a >= 100 * candidates[q[i : i + k]]}
        kept = []
        for q, a in candidates.items():
            if q not in dropped:
                score, k = min((1000 * a * n[lang] // (found[q[:k]] * found[q[k:]]), k) for k in range(1, len(q)))
                kept.append((-score, -a, " ".join(q).encode(), found[q[:k]], found[q[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrases(table, **options):
    return sorted(tuple(r) for r in collocations.collocations(table, **options).select(*PHRASE_COLUMNS).collect())


def prose(seed, docs=1200):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "Zz", "a\x0bb", "x\ty"]
    rows = [("en", None), ("en", ""), (None, "One of the kind " * 120), ("fr", "only " * 99 + "once")]
    for _ in range(docs):
        said = []
        for _ in range(rng.randrange(40)):
            said.append(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))])[0])
            said += ["One", "of", "the", "kind"] if rng.random() < 0.1 else []
            said += ["aa"] * 6 if rng.random() < 0.05 else []
            said[-1] += rng.choice(".,;\n") if rng.random() < 0.1 else ""
        rows.append((rng.choice(["en", "en", "en", "fr", None, "und"]), " ".join(said)))
    return rows + rows[-50:]


@pytest.mark.parametrize("top", [5, 30, 2000])
def test_phrases_equal_brute_force(spark, top):
    rows = prose(1)
    table = spark.createDataFrame(rows, "lang string, text string").repartition(5).withColumn("score", F.lit(1)).withColumn("id", F.lit("x"))
    assert phrases(table, top=top) == brute_phrases(rows, top)


def test_frontier_leaves_out_words_below_the_last_place(spark, monkeypatch):
    rows = prose(2) + [("en", f"p{i} q{i}") for i in range(5) for _ in range(100)]
    taken, stage = [], collocations.stage

    def watched(table, name):
        done = stage(table, name)
        if name == "frontier":
            taken.append(done.count())
        return done

    monkeypatch.setattr(collocations, "stage", watched)
    table = spark.createDataFrame(rows, "lang string, text string")
    assert phrases(table, top=3) == brute_phrases(rows, 3)
    pruned = max(taken)
    taken.clear()
    phrases(table, top=2000)
    assert pruned < max(taken)


def test_one_very_long_text_and_ids_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(collocations, "ROW_WORDS", 50)
    rng = random.Random(4)
    text = " ".join(rng.choice("abcdefg") + rng.choice(["", "", "", "."]) for _ in range(30_000))
    rows = [("en", text), ("en", text[:1000])]
    assert phrases(spark.createDataFrame(rows, "lang string, text string")) == brute_phrases(rows, 2000)


def test_no_frequent_phrases(spark):
    assert phrases(spark.createDataFrame([], "lang string, text string")) == []
    assert phrases(spark.createDataFrame([("en", "a b c")], "lang string, text string")) == []


def test_scores_pass_64_bits(spark):
    """Two words whose counts make 1000 a n exceed 64 bits are scored exactly."""
    many = 3_000_000_000_000
    words = spark.createDataFrame([(1, "en", "a", many, 9 * many), (2, "en", "b", many + 1, 9 * many)], "id long, lang string, word string, f long, n long")
    level = spark.createDataFrame([(1, 2, 2, many - 7, 5)], "head long, last long, tail long, a long, gram long")
    row = collocations.scored({2: level}, words).first()
    assert row.score == 1000 * (many - 7) * 9 * many // (many * (many + 1))


# --- conversation trie ------------------------------------------------------------


def brute_trie(rows):
    said = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())} {role}{text}".encode()).hexdigest()[:32]
            said[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {conv: [turn for *_, turn in sorted(turns)] for conv, turns in said.items()}
    members, children, ends = collections.defaultdict(list), collections.defaultdict(set), collections.defaultdict(list)
    for conv in own:
        shared = zlib.crc32(str(conv).encode()) % 6
        base = conv - int(math.fmod(conv, 100))
        path = tuple(own.get(base, [])[:shared] + own[conv][shared:])
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
            if d:
                children[path[: d - 1]].add(path[:d])
        ends[path].append(conv)
    leaves, saved = collections.Counter(), collections.Counter()
    for path, found in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(found) - 1) * (len(path[-1][1]) if path else 0)
            leaves[path[:d]] += not children.get(path)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children.get(p, ())), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items()
    )


def trie(table, **options):
    found = conversation_trie.build(conversation_trie.rebuilt(table), **options).fillna(-1, ["parent_conv_id"])
    return sorted(tuple(r) for r in found.select(*TRIE_COLUMNS).collect())


def talks(seed, convs=400):
    rng, rows = random.Random(seed), [(None, 1, "user", "x")]
    for _ in range(convs):
        conv = rng.choice([rng.randrange(400), rng.randrange(3000), -rng.randrange(300)])
        for turn in range(rng.choice([0, 1, 1, 2, 3, 4, 7, 9])):
            rows.append((conv, rng.choice([turn, turn, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "é", None, ""])))
    return rows


@pytest.mark.parametrize("shard_nodes", [5, 40, 1 << 18])
def test_trie_equals_brute_force(spark, shard_nodes):
    rows = talks(shard_nodes)
    table = spark.createDataFrame(rows, TALK).withColumn("path", F.lit(1)).withColumn("depth", F.lit("x"))
    assert trie(table, shard_nodes=shard_nodes) == brute_trie(rows)


def test_one_talk_in_a_third_of_all_conversations_and_a_very_long_one(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "MEMBERS", 16)
    rows = [(1000 + 7 * c, t, "user", f"same {t}") for c in range(150) for t in range(3)]
    rows += [(50_000, t, "user", "x" * (t % 7)) for t in range(1500)] + [(50_001, 0, "user", "y" * 200_000)]
    rows += talks(9, 100)
    assert trie(spark.createDataFrame(rows, TALK), shard_nodes=64) == brute_trie(rows)


def test_trie_of_few_rows(spark):
    assert trie(spark.createDataFrame([], TALK)) == []
    for rows in ([(7, 1, "u", "x")], [(7, None, None, None)] * 3, [(101, 0, "u", "x")]):
        assert trie(spark.createDataFrame(rows, TALK)) == brute_trie(rows)


def test_find_close():
    rng = random.Random(6)
    for size in [0, 1, 5, 63, 64, 65, 700, 5000]:
        for share in (0.3, 0.5, 0.9):
            bits, height = [1], 1
            for _ in range(size):
                bits.append(1 if height == 1 or rng.random() < share else 0)
                height += 2 * bits[-1] - 1
            bits += [0] * height
            stack, want = [], {}
            for at, bit in enumerate(bits):
                if bit:
                    stack.append(at)
                else:
                    want[stack.pop()] = at
            tree = conversation_trie.Parentheses(np.array(bits, np.uint8))
            assert tree.find_close(tree.opens).tolist() == [want[at] for at in tree.opens.tolist()]


# --- document fingerprints --------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_signature(text):
    """Byte by byte, without blocks or groups."""
    data = text.encode()
    levels = []
    for at in range(len(data)):
        rolled = 0
        for back in range(min(fingerprint.WINDOW, at + 1)):
            rolled += int(fingerprint._SPREAD[data[at - back]]) * pow(fingerprint._FACTOR, back, 1 << 32)
        rolled &= 0xFFFFFFFF
        rolled ^= rolled >> 15
        rolled = rolled * fingerprint._MIX & 0xFFFFFFFF
        rolled ^= rolled >> 13
        levels.append((rolled & -rolled).bit_length() - 1 if rolled else 32)
    size = fingerprint.LOWEST
    while sum(level >= size for level in levels) > fingerprint.CHUNKS:
        size += 1
    grains = []
    for grain in range(fingerprint.GRAINS):
        codes, start = [], 0
        for end in [at + 1 for at, level in enumerate(levels) if level >= size + grain] + [len(data)]:
            if end > start:
                codes.append(zlib.crc32(data[start:end]) >> 20)
            start = end
        grains.append(codes)
    return size, grains


def brute_likeness(a, b):
    if a == b:
        return 1.0
    best = 0.0
    for i, left in enumerate(a[1]):
        for j, right in enumerate(b[1]):
            if a[0] + i == b[0] + j and (left or right):
                best = max(best, 1 - distance(left, right) / max(len(left), len(right)))
    return best


def sample_texts(seed, count=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéüß中", k=rng.randrange(1, 9))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 30, 200, 600]))) for _ in range(count)]
    return texts + ["", "a", "ab" * 400, "a" * 3000]


def test_signatures_equal_a_byte_by_byte_version(monkeypatch):
    texts = sample_texts(1)
    want = [brute_signature(t) for t in texts]
    assert fingerprint.signatures([t.encode() for t in texts]) == want
    monkeypatch.setattr(fingerprint, "BLOCK", 100)
    assert fingerprint.signatures([t.encode() for t in texts]) == want
    assert [fingerprint.parse(fingerprint.spell(s)) for s in want] == want


def test_edit_distances():
    rng = random.Random(2)
    pairs = [([rng.randrange(4) for _ in range(rng.randrange(15))], [rng.randrange(4) for _ in range(rng.randrange(15))]) for _ in range(700)]
    assert fingerprint.edit_distances(pairs).tolist() == [distance(a, b) for a, b in pairs]


@pytest.mark.parametrize("task_bytes", [300, 1 << 30])
def test_compare_with_next(spark, task_bytes):
    texts = sample_texts(3, 80)
    rows = [(i, None if not t else t) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    table = table.withColumn("key", F.lit(1)).withColumn("body", F.lit("x")).withColumn("part", F.lit(2))
    found = {r.doc_id: r for r in fingerprint.compare_with_next(table, task_bytes=task_bytes).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        following = texts[i - 1] if i else texts[-1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        own, row = brute_signature(text), found[i]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert row.fingerprint == fingerprint.spell(own)
        assert row.edited_fingerprint == fingerprint.spell(brute_signature(changed))
        assert row.near_edited == brute_likeness(own, brute_signature(changed))
        assert row.near_next == brute_likeness(own, brute_signature(following))


def test_repeated_rows_null_keys_and_few_rows(spark):
    schema = "doc_id long, text string"
    assert fingerprint.compare_with_next(spark.createDataFrame([], schema)).count() == 0
    one = fingerprint.compare_with_next(spark.createDataFrame([(1, "abcd")], schema)).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(1, 1.0)] and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    rows = [(1, "same text")] * 40 + [(None, "x"), (None, None)]
    found = fingerprint.compare_with_next(spark.createDataFrame(rows, schema), task_bytes=20)
    assert found.count() == 42 and found.filter("near_next = 1").count() == 39
    assert found.filter("doc_id = 1").select("fingerprint").distinct().count() == 1


def test_half_edited_texts_are_told_from_others(spark):
    texts = [t for t in sample_texts(5, 150) if len(t) > 40]
    found = fingerprint.compare_with_next(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(r.near_edited > 0.25 for r in found) > 0.95 * len(found)
    assert sum(r.near_next < 0.25 for r in found) > 0.95 * len(found)


def test_columns_are_passed_through(spark):
    table = spark.createDataFrame([("a", "x y", 5), ("b", None, 6)], "row string, text string, fingerprint int")
    found = fingerprint.fingerprint_texts(table).orderBy("row").collect()
    assert [(r.row, r.text, r.n_chars, r.fingerprint) for r in found] == [("a", "x y", 3, fingerprint.spell(brute_signature("x y"))), ("b", None, 0, "2:::")]
    pairs = spark.createDataFrame([("2:::", "2:::"), (None, "2:::")], "left string, right string")
    assert [r.likeness for r in fingerprint.likeness(pairs, "left", "right").collect()] == [1.0, None]


def test_queries_are_registered():
    for name in ("op11_phrase_collocations", "op12_conversation_trie", "op13_document_fingerprints"):
        assert name in queries.QUERIES
    assert "op11_phrase_collocations" in queries.ORACLES
