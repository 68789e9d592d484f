import random
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from kairoscope.llm import packing


def padding(length, size):
    return 0 if length & (length - 1) == 0 else size - length


def brute_cost(positions, prices, size):
    best = [0.0] + [float("inf")] * (len(positions) - 1)
    for j in range(1, len(positions)):
        for i in range(j):
            length = positions[j] - positions[i]
            if length <= size:
                best[j] = min(best[j], best[i] + padding(length, size) + prices[j])
    return best[-1]


def test_cuts_are_cheapest():
    rng = random.Random(5)
    for size in (8, 16, 64):
        for _ in range(60):
            gaps = [rng.randint(1, size // 2) for _ in range(rng.randint(1, 40))]
            positions = np.cumsum([0, *gaps])
            prices = np.array([0] + [rng.choice([0, 2, 5]) for _ in gaps])
            cuts = packing.choose_cuts(positions, prices, size)
            cost = sum(padding(positions[b] - positions[a], size) + prices[b] for a, b in zip(cuts, cuts[1:], strict=False))
            assert cuts[0] == 0 and cuts[-1] == len(positions) - 1
            assert cost == brute_cost(positions, prices, size)


def test_pieces_cover_every_token(docs, vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "HARD_STEP", 16)
    rng = random.Random(2)
    words = ["one", "two.", "three", "Four!", "five\n", "six"]
    rows = [(n, " ".join(rng.choices(words, k=rng.randint(0, 300)))) for n in range(60)] + [(100, None), (101, ""), (101, ""), (102, "x" * 5000)]
    table = docs(rows, start="clash").coalesce(2)
    pieces = packing.pack(table, vocabulary, size=128).collect()
    library = Tokenizer.from_file(vocabulary)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        assert len(p.ids) == 4 * p.length and p.length > 0
    for sequence in by_sequence.values():
        at = 0
        for p in sorted(sequence, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 128
    for doc_id, text in rows:
        want = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        parts = sorted(by_doc[doc_id], key=lambda p: p.start)
        if doc_id == 101:
            assert [(p.start, p.length, p.doc_tokens) for p in parts] == [(0, 1, 1), (0, 1, 1)]
            continue
        assert [p.start for p in parts] == list(np.cumsum([0] + [p.length for p in parts])[:-1])
        assert np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist() == want
        assert {p.doc_tokens for p in parts} == {len(want)}
    lengths = [sum(p.length for p in s) for s in by_sequence.values()]
    wasted = sum(padding(x, 128) for x in lengths)
    assert wasted < 0.1 * sum(lengths)


def test_empty_table(docs, vocabulary):
    assert packing.pack(docs([]), vocabulary).collect() == []


def test_groups_carry_the_rest_over(docs, vocabulary, monkeypatch):
    """The same ids whether a partition is one group of texts or many."""
    from kairoscope.llm import bpe

    rows = [(n, "Some words here. " * n) for n in range(40)]
    whole = packing.pack(docs(rows).coalesce(1), vocabulary, size=64).collect()
    assert sum(p.length for p in whole) == sum(p.doc_tokens for p in whole if p.start == 0)
    assert bpe.GROUP_CHARS > 0
