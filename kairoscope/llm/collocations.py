"""Phrase collocations by best-first branch-and-bound growth of prefixes and suffixes.

The score of a phrase is ``floor(1000 a n / (l r))`` for its weakest cut. Since ``a`` is at
most ``r`` and at most ``l``, no phrase scores above ``floor(1000 n / f)`` with ``f`` the count
of its first word, or of its last one. The words with the highest bounds are the frontier:
phrases are grown word by word behind a first word of the frontier, as long as the prefix
is frequent, and before a last word of the frontier, as long as the suffix is, so that both
counts of every cut are known. When a language's 2000th surviving score is known, words
whose bound is below it can start or end no phrase of the result, ties included; the
frontier takes in all others, and a second expansion settles every language. Only phrases
that were out of reach before are counted then.

Texts are cut into words twice, once to count the words and once to write them as ids of
64 bits, zero for rare words and borders of pieces. An id is a hash of language and word;
that no frequent word shares its id is checked, otherwise another seed is taken. Every level
is a pass over these ids: tasks sum their own counts of ``(prefix, last word)`` and send
only sums. Which words are in the frontier and which phrases are frequent is told to the
tasks by bitmaps of a bounded size; a wrong positive only counts a phrase that is then found
rare, or for nothing. A phrase lies inside a longer candidate of the same count if all its
occurrences have the same left, or the same right, neighbour.

Nothing is grouped by language but small tables, so a language that holds most documents,
or a word that is in all of them, does not meet in a task. A null text counts as empty, a
null language as ``und``. Very long texts are whole in their task, as they came. Repeated
rows count as often as they occur. Other columns are not used; an empty table, or one
without frequent phrases, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .bpe import text_groups
from .workers import tidy

LEAST = 100
LONGEST = 5
TOP = 2000
#: The first frontier holds the rarest words, up to this share of a language's words.
FIRST_SHARE = 0.125
#: Bits of a bitmap for each number in it, and most slots of 64 bits: 8 MB, whatever the data.
BITS = 32
SLOTS = 1 << 20
#: Positions of the coded texts handled at a time.
CHUNK = 1 << 18
#: Different words a task remembers at a time, of all languages.
KNOWN_WORDS = 200_000
#: Coded words in a row. Spark's reader holds 4096 rows at a time, 16 MB of these.
ROW_WORDS = 1 << 9
#: Rows that a task sends at a time.
SENT_ROWS = 1 << 16

_BREAK = b"."
_CUT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")


def cut_words(text: str) -> list[bytes]:
    """Words of a text, ``.`` between its pieces."""
    return text.encode().lower().translate(_CUT).replace(b"\n", b" . ").split()


def word_id(seed: int, lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + word, seed) or 1


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Ids(dict):
    """Ids of frequent words, 0 for others."""

    def __init__(self, seed: int, lang: str, frequent: np.ndarray):
        self[_BREAK] = 0
        self.seed, self.lang, self.frequent = seed, lang, frequent

    def __missing__(self, word: bytes) -> int:
        n = word_id(self.seed, self.lang, word)
        if not int(self.frequent[(n >> 6) & (len(self.frequent) - 1)]) >> (n & 63) & 1:
            n = 0
        if len(self) > KNOWN_WORDS:
            self.clear()
            self[_BREAK] = 0
        self[word] = n
        return n


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of a bounded size: what receives it holds a part at a time."""
    for start in range(0, batch.num_rows, SENT_ROWS):
        yield batch.slice(start, SENT_ROWS)


def _source(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    )


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Words of groups of texts of one language, pieces and texts apart."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for low, high in text_groups(texts):
            groups: dict[str, list[str]] = {}
            for lang, text in zip(langs[low:high], texts[low:high], strict=True):
                groups.setdefault(lang, []).append(text)
            for lang, some in groups.items():
                yield lang, cut_words("\n".join(some))


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """``lang``, ``word``, ``id`` and ``f``, the word's occurrences."""

    def rows(lang: str, known: Numbers, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        every = ((w, n) for w, n in zip(known, counts, strict=True) if n and w != _BREAK)
        while seen := list(islice(every, SENT_ROWS)):
            ids = np.array([word_id(seed, lang, w) for w, _ in seen], np.uint64).view(np.int64)
            words = pa.array([w for w, _ in seen], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), words, pa.array(ids), pa.array([n for _, n in seen], pa.int64())], ["lang", "word", "id", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[Numbers, np.ndarray]] = {}
        for lang, words in _by_lang(batches):
            numbers, counts = known.get(lang) or (Numbers(), np.zeros(0, np.int64))
            more = np.bincount(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), minlength=len(numbers))
            more[: len(counts)] += counts
            known[lang] = numbers, more
            while sum(len(n) for n, _ in known.values()) > KNOWN_WORDS:
                most = max(known, key=lambda x: len(known[x][0]))
                yield from rows(most, *known.pop(most))
        for lang, (numbers, counts) in known.items():
            yield from rows(lang, numbers, counts)

    made = docs.mapInArrow(tidy(run), "lang string, word string, id long, n long")
    return made.groupBy("lang", "word", "id").agg(F.sum("n").alias("f"))


def bitmap(table: DataFrame, column: str) -> np.ndarray:
    """A bounded number of bits, those of the column's values set."""
    slots = 1 << min((table.count() * BITS // 64).bit_length(), SLOTS.bit_length() - 1)
    slot = F.expr(f"shiftright({column}, 6) & {slots - 1}L").alias("slot")
    found = table.groupBy(slot).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(slots, np.uint64)
    bits[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


def has(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = (values >> np.uint64(6)) & np.uint64(len(bits) - 1)
    return (bits[place] >> (values & np.uint64(63))) & np.uint64(1) == 1


def code_words(docs: DataFrame, seed: int, frequent: Broadcast) -> DataFrame:
    """Rows of word ids, of whole groups of pieces; each ends with a zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Ids] = {}
        for lang, words in _by_lang(batches):
            if sum(map(len, known.values())) > KNOWN_WORDS:
                known.clear()
            if lang not in known:
                known[lang] = Ids(seed, lang, frequent.value)
            ids = np.zeros(len(words) + 1, np.uint64)
            ids[:-1] = np.fromiter(map(known[lang].__getitem__, words), np.uint64, len(words))
            # Zeros that follow each other say no more than one: pieces are apart anyway.
            ids = ids[np.concatenate([(ids[:-1] != 0) | (ids[1:] != 0), [True]])]
            ends = np.flatnonzero(ids == 0) + 1
            cuts = ends[np.unique(np.searchsorted(ends, np.arange(ROW_WORDS, len(ids) + ROW_WORDS, ROW_WORDS)).clip(max=len(ends) - 1))]
            offsets = np.concatenate([[0], cuts[cuts < len(ids)], [len(ids)]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view(np.int64)))], ["ids"])

    return docs.mapInArrow(tidy(run), "ids array<long>")


def mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number for a phrase and the word behind it."""
    h = left * np.uint64(0x9E3779B97F4A7C15) + right
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def fold(ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the phrases of a length that begin at the given places."""
    h = ids[at]
    for step in range(1, length):
        h = mix(h, ids[at + step])
    return h


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Word ids of whole rows, a bounded number at a time, zeros around them."""
    held, size = [np.zeros(1, np.uint64)], 0
    for batch in batches:
        lists = batch.column(0)
        flat, offsets = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        for start, stop in zip(offsets[:-1], offsets[1:], strict=True):
            held.append(flat[start:stop])
            size += stop - start
            if size >= CHUNK:
                yield np.concatenate([*held, np.zeros(1, np.uint64)])
                held, size = held[:1], 0
    if size:
        yield np.concatenate([*held, np.zeros(1, np.uint64)])


#: The frontier's bitmap and that of the frequent phrases one word shorter, as sent to the tasks.
Reach = tuple[Broadcast, Broadcast | None]


def _values(reach: Reach) -> tuple[np.ndarray, np.ndarray | None]:
    return reach[0].value, None if reach[1] is None else reach[1].value


def _reached(reach: tuple[np.ndarray, np.ndarray | None], ids: np.ndarray, at: np.ndarray, length: int, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    frontier, known = reach
    first, last = has(frontier, ids[at]), has(frontier, ids[at + length - 1])
    return first | last if known is None else (first & has(known, heads)) | (last & has(known, tails))


def _whole(ids: np.ndarray, length: int) -> np.ndarray:
    """Places from which ``length`` words follow without a border."""
    real = ids != 0
    run = real[: len(ids) - length + 1].copy()
    for step in range(1, length):
        run &= real[step : len(ids) - length + 1 + step]
    return np.flatnonzero(run)


def grow(coded: DataFrame, length: int, reach: Reach, before: Reach | None) -> DataFrame:
    """Counts of the phrases of a length in reach now and not before: ``head`` and ``tail``, the
    numbers of their first and last ``length - 1`` words, ``last``, their last word, and ``a``."""
    names = ["head", "last", "n"] if length == 2 else ["head", "last", "tail", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, old = _values(reach), None if before is None else _values(before)
        for ids in _chunks(batches):
            at = _whole(ids, length)
            heads, tails = fold(ids, at, length - 1), fold(ids, at + 1, length - 1)
            wanted = _reached(now, ids, at, length, heads, tails)
            if old is not None:
                wanted &= ~_reached(old, ids, at, length, heads, tails)
            heads, tails, last = heads[wanted], tails[wanted], ids[at[wanted] + length - 1]
            if not len(heads):
                continue
            number = mix(heads, last)
            order = np.argsort(number)
            columns = [c[order] for c in ((number, heads, last) if length == 2 else (number, heads, last, tails))]
            new = np.zeros(len(order), bool)
            new[0] = True
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new)
            n = np.diff(np.append(starts, len(order)))
            yield from _slices(pa.RecordBatch.from_arrays([*[pa.array(c[starts].view(np.int64)) for c in columns[1:]], pa.array(n.astype(np.int64))], names))

    made = coded.mapInArrow(tidy(run), ", ".join(f"{name} long" for name in names))
    counted = made.groupBy(*names[:-1]).agg(F.sum("n").alias("a")).filter(F.col("a") >= LEAST)
    if length == 2:
        counted = counted.withColumn("tail", F.col("last"))
    return counted.select("head", "last", "tail", "a").mapInArrow(tidy(_number), "head long, last long, tail long, a long, gram long")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        head, last = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mix(head, last).view(np.int64))], [*batch.schema.names, "gram"])


def enclosed(coded: DataFrame, known: dict[int, Broadcast]) -> DataFrame:
    """``size`` and ``gram`` of the phrases whose occurrences all have one neighbour word on a side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in _chunks(batches):
            for length, bits in known.items():
                at = _whole(ids, length)
                number = fold(ids, at, length)
                wanted = has(bits.value, number)
                at, number = at[wanted], number[wanted]
                if not len(at):
                    continue
                order = np.argsort(number)
                at, number = at[order], number[order]
                starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
                sides = []
                for place in (at - 1, at + length):
                    word = ids[place]
                    low, high = np.minimum.reduceat(word, starts), np.maximum.reduceat(word, starts)
                    sides.append(np.where(low == high, low, 0).view(np.int64))
                size = np.full(len(starts), length, np.int32)
                yield from _slices(pa.RecordBatch.from_arrays([pa.array(size), pa.array(number[starts].view(np.int64)), *map(pa.array, sides)], ["size", "gram", "left", "right"]))

    made = coded.mapInArrow(tidy(run), "size int, gram long, left long, right long")
    ends = made.groupBy("size", "gram").agg(*[f(c).alias(f"{n}_{c}") for c in ("left", "right") for f, n in ((F.min, "low"), (F.max, "high"))])
    same = lambda c: (F.col(f"low_{c}") == F.col(f"high_{c}")) & (F.col(f"low_{c}") != 0)
    return ends.filter(same("left") | same("right")).select("size", "gram")


def scored(levels: dict[int, DataFrame], words: DataFrame) -> DataFrame:
    """All phrases whose cuts are known: ``size``, ``gram``, ``lang``, ``words``, ``a``, ``l``, ``r``, ``n``, ``score``."""
    first = words.select(F.col("id").alias("head"), "lang", "n", F.col("f").alias("l"))
    final = words.select(F.col("id").alias("tail"), F.col("f").alias("r"))
    pairs = levels[2].join(first, "head").join(final, "tail")
    rows = pairs.select(
        "gram", "lang", "n", "a", F.array("head", "tail").alias("words"), F.array("l").alias("lefts"), F.array("r").alias("rights"),
    )
    found, upper = [rows], rows
    for size in range(3, LONGEST + 1):
        if size not in levels:
            break
        upper = stage(upper, "phrases")
        # Prefixes are known behind a first word of the frontier, suffixes before a last one.
        front = upper.select(F.col("gram").alias("head"), "lang", "n", "words", "lefts", F.col("a").alias("front_a"))
        back = upper.select(F.col("gram").alias("tail"), "rights", F.col("a").alias("back_a"))
        joined = levels[size].join(front, "head", "left").join(back, "tail", "left")
        upper = joined.select(
            "gram", "lang", "n", "a", F.array_append("words", F.col("last")).alias("words"),
            F.array_append("lefts", F.col("front_a")).alias("lefts"), F.array_prepend("rights", F.col("back_a")).alias("rights"),
        )
        found.append(upper)
    every = None
    for size, rows in enumerate(found, 2):
        rows = rows.filter("lefts is not null and rights is not null").withColumn("size", F.lit(size))
        every = rows if every is None else every.unionByName(rows)
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    cut = f"""array_min(transform(sequence(0, size - 2), i -> struct(
        ({wide('a')} * {wide('n')} * 1000) div ({wide('lefts[i]')} * {wide('rights[i]')}) as score, i as k, lefts[i] as l, rights[i] as r)))"""
    return every.withColumn("cut", F.expr(cut)).select("size", "gram", "lang", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def _frontier(words: DataFrame, share: float) -> DataFrame:
    """The rarest words of each language, by steps of their counts, up to a share of its words."""
    step = F.floor(F.log2("f") * 4).alias("step")
    steps = words.groupBy("lang", step).agg(F.sum("f").alias("mass"), F.max("n").alias("n"))  # some 250 a language
    upto = F.sum("mass").over(Window.partitionBy("lang").orderBy("step"))
    taken = steps.withColumn("upto", upto).filter(F.col("upto") <= share * F.col("n")).groupBy("lang").agg(F.max("step").alias("last_step"))
    return words.withColumn("step", step).join(taken, "lang").filter("step <= last_step").select("id")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", share: float = FIRST_SHARE, top: int = TOP) -> DataFrame:
    """The first ``top`` surviving phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``."""
    source = _source(docs, lang, text)
    spark = docs.sparkSession
    for seed in range(16):
        counted = stage(count_words(source, seed), "words")
        shared = counted.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("f").alias("f"))
        if shared.filter((F.col("n") > 1) & (F.col("f") >= LEAST)).isEmpty():
            break
    else:
        raise ValueError("frequent words share their ids for every seed")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    words = stage(counted.filter(F.col("f") >= LEAST).join(totals, "lang").select("id", "lang", "word", "f", "n"), "frequent")
    told = spark.sparkContext.broadcast(bitmap(words, "id"))
    coded = stage(code_words(source, seed, told), "coded")
    # Staged tables need no bitmap again; executors would keep each until the driver collects its garbage.
    told.destroy()

    frontier = stage(_frontier(words, share), "frontier")
    levels: dict[int, DataFrame] = {}
    before: dict[int, Reach] = {}
    sent: list[Broadcast] = []

    def tell(table: DataFrame, column: str) -> Broadcast:
        sent.append(spark.sparkContext.broadcast(bitmap(table, column)))
        return sent[-1]

    while True:
        past, sent = sent, []
        inside, known = tell(frontier, "id"), {}
        for size in range(2, LONGEST + 1):
            reach = inside, known.get(size - 1)
            fresh = grow(coded, size, reach, before.get(size))
            levels[size] = stage(levels[size].unionByName(fresh) if size in levels else fresh, "level")
            before[size] = reach
            if levels[size].isEmpty():
                del levels[size]
                break
            known[size] = tell(levels[size], "gram")
        for bits in past:
            bits.destroy()
        if 2 in levels:
            inner = stage(enclosed(coded, {size: bits for size, bits in known.items() if size < LONGEST}), "enclosed")
            survivors = stage(scored(levels, words).join(inner, ["size", "gram"], "left_anti"), "survivors")
            in_order = Window.partitionBy("lang").orderBy(F.desc("score"))
            best = survivors.select("lang", "score").withColumn("place", F.row_number().over(in_order)).filter(F.col("place") <= top)
            settled = best.filter(F.col("place") == top).select("lang", F.col("score").alias("settled"))
        else:
            survivors = spark.createDataFrame([], "size int, gram long, lang string, words array<long>, a long, l long, r long, n long, score long")
            settled = survivors.select("lang", F.col("score").alias("settled"))
        # Words whose bound reaches the score of the last place, ties included.
        reaches = "settled is null or cast(n as decimal(19, 0)) * 1000 >= cast(settled as decimal(19, 0)) * cast(f as decimal(19, 0))"
        wanted = words.join(settled, "lang", "left").filter(reaches).select("id")
        more = stage(wanted.join(frontier, "id", "left_anti"), "more")
        if more.isEmpty():
            break
        frontier = stage(frontier.unionByName(more), "frontier")
    for bits in sent:
        bits.destroy()

    tied = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = survivors.withColumn("place", F.rank().over(tied)).filter(F.col("place") <= top).drop("place")
    spelt = first.select("size", "gram", F.posexplode("words").alias("at", "id")).join(words.select("id", "word"), "id")
    phrase = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase")
    named = first.drop("words").join(spelt.groupBy("size", "gram").agg(phrase), ["size", "gram"])
    last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(last).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: Every phrase counted, every score computed: the same rows without any bound.
ORACLE = r"""
with texts as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
pieces as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) p from texts),
lists as (select lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') w from pieces),
spans as (select lang, w, unnest(range(1, len(w) + 1)) i from lists),
grams as (select lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') g from spans, range(1, 6) t(k) where i + k - 1 <= len(w)),
f as (select lang, k::int k, g, count(*)::hugeint c from grams group by all having count(*) >= 100),
total as (select lang, sum(len(w))::hugeint n from lists group by lang),
cand as (select lang, k size, g, c a, string_split(g, ' ') w from f where k > 1),
cuts as (select cand.*, j, array_to_string(list_slice(w, 1, j), ' ') left_g, array_to_string(list_slice(w, j + 1, size), ' ') right_g from cand, range(1, 5) t(j) where j < size),
s as (select cuts.lang, cuts.size, cuts.g, cuts.w, cuts.a, x.c l, y.c r, n, (1000 * cuts.a * n) // (x.c * y.c) score,
    row_number() over (partition by cuts.lang, cuts.g order by (1000 * cuts.a * n) // (x.c * y.c), j) o
    from cuts join f x on x.lang = cuts.lang and x.k = j and x.g = left_g join f y on y.lang = cuts.lang and y.k = cuts.size - j and y.g = right_g
    join total on total.lang = cuts.lang),
inside as (select distinct lang, array_to_string(list_slice(w, b, b + m - 1), ' ') g, m, a from cand, range(2, 5) u(m), range(1, 5) t(b) where m < size and b + m - 1 <= size),
dropped as (select s.lang, s.g from s join inside i on i.lang = s.lang and i.g = s.g and i.m = s.size where s.o = 1 and 100 * i.a >= 100 * s.a),
ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, g) rank, g phrase, a, l, r, n, score
    from s where o = 1 and not exists (select 1 from dropped d where d.lang = s.lang and d.g = s.g))
select lang, rank::bigint rank, phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score from ranked where rank <= 2000
"""
