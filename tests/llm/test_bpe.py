import random

import pytest
from tokenizers import Tokenizer

from kairoscope.llm import bpe

ODD = [
    "", " ", "  ", "a", "\n", " \n \n b", "a \n\n  b", "a  b", "a   b\t c", "tail  ", "it's they'll I'd 'sx", "x y  z", "1234 5678",
    "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>", "  <|endoftext|>  x", "café naïve 日本語 🙂🙂 ‍", "aaaa" * 50, "!!!??? ***",
    "\x00\x1c \x1d", "a \x1c b", "Ünï cödé\r\n\r\n x",
]


def random_texts(seed, count):
    rng = random.Random(seed)
    alphabet = "aabcdethinors  \n\t.,'!éß日🙂01"
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(count)]


@pytest.mark.parametrize("small", [False, True])
def test_trie_equals_library_and_decodes(vocabulary, monkeypatch, small):
    if small:  # the bounded tables are emptied again and again
        monkeypatch.setattr(bpe, "TRIE_NODES", 50)
        monkeypatch.setattr(bpe, "STABLE_PAIRS", 20)
        monkeypatch.setattr(bpe, "PIECES", 10)
        monkeypatch.setattr(bpe, "PIECE_CHARS", 4)
    library = Tokenizer.from_file(vocabulary)
    codec, ranks = bpe.Codec(vocabulary), bpe.RankCodec(vocabulary)
    texts = ODD + random_texts(1, 600)
    for low in range(0, len(texts), 50):
        part = texts[low : low + 50]
        for text, ids in zip(part, codec.encode_batch(part), strict=True):
            want = library.encode(text, add_special_tokens=False).ids
            assert memoryview(ids).cast("I").tolist() == want, repr(text)
            assert ranks.encode(text).tolist() == want, repr(text)
            assert codec.decode(ids) == library.decode(want, skip_special_tokens=False) == text


def merged(words, data):
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        ranked = [(words.rank[pair], n) for n, pair in enumerate(zip(parts, parts[1:], strict=False)) if pair in words.rank]
        if not ranked:
            return parts
        _, n = min(ranked)
        parts[n : n + 2] = [parts[n] + parts[n + 1]]


def test_stable_pairs_equal_merging(vocabulary):
    words = bpe.Vocabulary(vocabulary)
    rng = random.Random(3)
    ids = list(words.id_of.values())
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(3000)] + [(words.id_of[b"a"], words.id_of[b"a"]), (words.id_of[b"aa"], words.id_of[b"a"])]
    for left, right in pairs:
        a, b = words.bytes_of[left], words.bytes_of[right]
        assert words.stable(left, right) == (merged(words, a + b) == [a, b]), (a, b)


def test_table(docs, vocabulary):
    rows = bpe.encode(docs([(1, "hello world"), (2, None), (None, "x"), (1, "hello world")], ids=7), vocabulary).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in rows) == [(0, 1, "x"), (1, 2, "hello world"), (1, 2, "hello world"), (2, 0, "")]
    assert bpe.encode(docs([]), vocabulary).collect() == []
