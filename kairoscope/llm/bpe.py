"""Byte-level BPE encoding and decoding by a prefix-sharing trie of distinct words.

The distinct words of a batch go into a trie of bytes that lives as long as the
Python worker. Every trie node keeps one state, the last token of the encoding
of its prefix; the states are found depth first, so the encoding of a prefix that
many words share is computed once. A token may end a prefix when the prefix before
it is encoded with a last token that forms a stable pair with it, i.e. when merging
the bytes of the two gives these two tokens again; exactly one token qualifies.
Following the states back from a word's node yields its encoding.

Memory is bounded: the trie, the stable pairs and the table of text pieces are
emptied when they reach the documented sizes, and nothing depends on the contents
of another task, so a lost executor costs only a recomputation.

Nulls count as empty texts; an empty text has no ids and decodes to an empty text.
Repeated rows are encoded like any others. Extra columns, whatever their names,
are passed through; the result columns replace columns of the same name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import free_name

TRIE_NODES = 1_000_000
STABLE_PAIRS = 1_000_000
#: Two generations of so many pieces are kept.
PIECES = 300_000
#: Pieces longer than this are encoded but not remembered.
PIECE_CHARS = 64
#: Fixed value: how the byte-level vocabulary splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space between two white-space characters (or last after one) is no word start.
_UNSAFE_SPACE = re.compile(r"\s (?=\s|\Z)")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    letters.update({chr(256 + i): b for i, b in enumerate(rest)})
    return letters


class Vocabulary:
    """Tokens as bytes, merge ranks and special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        letters = _byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in spec["model"]["vocab"]}
        self.id_of = {raw[token]: i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.id_of.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, i in self.id_of.items():
            self.bytes_of[i] = token
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.rank = {}
        for n, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[raw[left], raw[right]] = n
        self.longest = max(map(len, self.id_of))
        #: Merges by the two ids, and for each token the merge that makes it.
        self.merge_rank, self.made = {}, {}
        for (left, right), n in self.rank.items():
            self.merge_rank[self.id_of[left] << 32 | self.id_of[right]] = n
            self.made[self.id_of[left + right]] = (self.id_of[left], self.id_of[right], n)
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def forget_merges(self) -> None:
        """Keep only tokens and special strings."""
        self.rank, self.merge_rank, self.made = {}, {}, {}

    def segments(self, text: str) -> list[str]:
        """The text cut at special strings; odd places hold the special strings."""
        return self._split.split(text) if self._split else [text]

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def stable(self, left: int, right: int) -> bool:
        """Whether merging the bytes of the two tokens gives the two tokens again.

        Goes back in time from the finished tokens: the parts that touch at the
        border must never merge before one of them is used up inside its own token.
        A merge of equal rank counts from the left, so it wins over the right token's.
        """
        never = len(self.rank)
        left_used = right_used = never
        while True:
            across = self.merge_rank.get(left << 32 | right, never)
            if across < left_used and across <= right_used and across < never:
                return False
            _, inner, left_made = self.made.get(left, (0, 0, -1))
            outer, _, right_made = self.made.get(right, (0, 0, -1))
            if left_made < 0 and right_made < 0:
                return True
            # Equal ranks: the left token's merge came first, so the right one's is undone first.
            if left_made > right_made:
                left, left_used = inner, left_made
            else:
                right, right_used = outer, right_made


class PrefixTrie:
    """Encodings of distinct words, computed once for each shared prefix."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.stable: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.child: dict[int, int] = {}
        self.last = [-1]
        self.before = [0]
        self.start = [0]

    def _is_stable(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) >= STABLE_PAIRS:
                self.stable.clear()
            known = self.stable[key] = self.vocabulary.stable(left, right)
        return known

    def _last(self, word: bytes, path: list[int], depth: int) -> tuple[int, int]:
        """The token that ends the first ``depth`` bytes, and the byte it starts at."""
        ids, last, stable = self.vocabulary.id_of, self.last, self.stable
        longer = self.start[path[-1]]  # most often the last token grows
        for start in (longer, *range(max(0, depth - self.vocabulary.longest), depth)):
            token = ids.get(word[start:depth])
            if token is None:
                continue
            if start == 0:
                return token, start
            left = last[path[start]]
            known = stable.get(left << 32 | token)
            if known or known is None and self._is_stable(left, token):
                return token, start
        raise ValueError("the vocabulary lacks single bytes")

    def _walk(self, word: bytes, path: list[int], done: int) -> None:
        """Extend the path of nodes from the first ``done`` bytes to the whole word."""
        child, node = self.child, path[-1]
        for depth in range(done + 1, len(word) + 1):
            edge = node << 8 | word[depth - 1]
            node = child.get(edge, 0)
            if not node:
                token, start = self._last(word, path, depth)
                node = child[edge] = len(self.last)
                self.last.append(token)
                self.before.append(path[start])
                self.start.append(start)
            path.append(node)

    def encode(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of every word; the words are visited depth first."""
        if len(self.last) > TRIE_NODES:
            self._clear()
        found, path, previous = {}, [0], b""
        for word in sorted(words):
            shared, limit = 0, min(len(previous), len(word))
            while shared < limit and previous[shared] == word[shared]:
                shared += 1
            del path[shared + 1 :]
            self._walk(word, path, shared)
            ids, node = [], path[-1]
            while node:
                ids.append(self.last[node])
                node = self.before[node]
            found[word] = ids[::-1]
            previous = word
        return found


class Codec:
    """Encoder and decoder of one vocabulary file, kept by each Python worker."""

    _kept: dict[tuple[type, str], Codec] = {}

    def __init__(self, path: str):
        import regex

        self.vocabulary = Vocabulary(path)
        self.trie = PrefixTrie(self.vocabulary)
        self.words = regex.compile(PATTERN)
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        """The worker's codec of this class for the file."""
        if (cls, path) not in cls._kept:
            cls._kept[cls, path] = cls(path)
        return cls._kept[cls, path]

    def _cut(self, text: str) -> list[str]:
        """Pieces whose words are those of the text: cut before every safe space."""
        if _UNSAFE_SPACE.search(text):
            return self.words.findall(text)
        first, *rest = text.split(" ")
        pieces = [" " + piece for piece in rest]
        return [first, *pieces] if first else pieces

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        cut = {piece: [w.encode() for w in self.words.findall(piece)] for piece in pieces}
        ids = self.trie.encode(list({word for words in cut.values() for word in words}))
        packed = {word: pack(f"<{len(found)}I", *found) for word, found in ids.items()}
        return {piece: b"".join(map(packed.__getitem__, words)) for piece, words in cut.items()}

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut: list[list[str]] = []
        for text in texts:
            text = text or ""
            if self.vocabulary.has_special(text):
                pieces = []
                for n, segment in enumerate(self.vocabulary.segments(text)):
                    pieces += [segment] if n % 2 else self._cut(segment) if segment else []
                cut.append(pieces)
            else:
                cut.append(self._cut(text) if text else [])
        if len(self.pieces) > PIECES:
            self.pieces, self.older = {}, self.pieces
        known, older = self.pieces, self.older
        new = {piece for pieces in cut for piece in pieces if piece not in known}
        again = {piece: older[piece] for piece in new if piece in older}
        known.update(again)
        new -= again.keys()
        special = {s: i.to_bytes(4, "little") for s, i in self.vocabulary.special.items() if s in new}
        learnt = self._learn(new - special.keys()) | special
        known.update((piece, ids) for piece, ids in learnt.items() if len(piece) <= PIECE_CHARS)
        long = {piece: ids for piece, ids in learnt.items() if len(piece) > PIECE_CHARS}
        if long:
            return [b"".join([long[p] if p in long else known[p] for p in pieces]) for pieces in cut]
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become replacement characters."""
        numbers = memoryview(ids).cast("I").tolist()
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, numbers)).decode("utf-8", "replace")


class RankCodec:
    """The same ids from a compiled rank encoder, for operators that only need ids.

    Right for vocabularies whose ids follow the order of their merges, which
    the constructor checks.
    """

    _kept: dict[str, RankCodec] = {}

    def __init__(self, path: str):
        import tiktoken

        self.vocabulary = Vocabulary(path)
        ranks = self.vocabulary.id_of
        made = [ranks[left + right] for left, right in self.vocabulary.rank]
        if made != sorted(made):
            raise ValueError("token ids do not follow the order of the merges")
        special = self.vocabulary.special
        self.vocabulary.forget_merges()
        self.compiled = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @classmethod
    def of(cls, path: str) -> RankCodec:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the text as unsigned 32-bit integers."""
        if not text:
            return np.empty(0, np.uint32)
        if self.vocabulary.has_special(text):
            return self.compiled.encode_to_numpy(text, allowed_special="all")
        return self.compiled.encode_to_numpy(text, disallowed_special=())


#: Texts are handled in groups of about so many characters, whatever the batch holds.
GROUP_CHARS = 2_000_000


def text_groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive groups of texts with a bounded number of characters."""
    start = size = 0
    for n, text in enumerate(texts):
        if size > GROUP_CHARS:
            yield start, n
            start, size = n, 0
        size += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (packed as little-endian unsigned 32-bit integers),
    ``n_tokens`` and, if asked for, ``decoded`` - the ids turned back into text.

    No shuffle: every input partition is encoded where it is read.
    """
    added = [("ids", T.BinaryType()), ("n_tokens", T.LongType()), *([("decoded", T.StringType())] if decoded else [])]
    names = {name.lower() for name, _ in added}
    kept = [c for c in docs.columns if c.lower() not in names]
    body = F.col(f"`{text}`").cast("string").alias(free_name("_text", kept))
    source = docs.select(*[F.col(f"`{c}`") for c in kept], body)
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(n, t) for n, t in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for low, high in text_groups(texts):
                ids = codec.encode_batch(texts[low:high])
                columns = [batch.column(i).slice(low, high - low) for i in range(batch.num_columns - 1)]
                columns += [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if decoded:
                    columns.append(pa.array([codec.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *[n for n, _ in added]])

    return source.mapInArrow(run, schema)
