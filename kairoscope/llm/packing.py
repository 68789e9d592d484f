"""Order-preserving packing of documents into sequences of bounded length.

The documents of an input partition, in their order, form one stream of tokens.
Cuts may be made at document ends (free), at sentence ends and, at a higher price,
inside long stretches without either. Dynamic programming chooses the cuts that
minimise padding plus cut prices: with cuts at positions ``p`` the cheapest way to
reach ``p[j]`` is ``size - p[j] + min(cost[i] + p[i])`` over the cuts at most ``size``
tokens back, a sliding-window minimum that a monotone queue yields in constant
amortised time. A sequence whose length is a power of two needs no padding; these
few transitions are looked up beside the queue.

There is no shuffle. A task holds one group of texts at a time: when a group ends,
its finished sequences are sent out and the tokens after the last cut open the next
group, so memory does not grow with the partition. Only the end of a partition is
charged for its open sequence. Sequence ids are the partition number and a counter,
so a repeated task gives the same ids again.

Nulls count as empty texts, of which only the closing id remains. Repeated rows are
packed each for itself, empty tables give no pieces, and columns whose names clash
with the result's are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import RankCodec, text_groups
from .workers import tidy

SIZE = 2048
END_ID = 1
#: Prices of a cut in tokens of padding.
SENTENCE_PRICE = 8
HARD_PRICE = 64
#: Stretches without a document or sentence end offer a hard cut at every so many tokens.
HARD_STEP = 128

PIECE_FIELDS = [
    ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()),
    ("sequence_id", T.LongType()), ("offset", T.LongType()),
]


def choose_cuts(positions: np.ndarray, prices: np.ndarray, size: int = SIZE, last: bool = True) -> list[int]:
    """Indices of the cheapest cuts, from 0 to the last position.

    ``positions`` start at 0, rise strictly and are at most ``size`` apart. With
    ``last`` unset the end is no real end: its sequence is not charged for padding.
    """
    count = len(positions)
    exact: dict[int, list[int]] = {}
    for power in range(size.bit_length()):
        if (length := 1 << power) <= size:
            at = np.searchsorted(positions, positions - length)
            for j in np.flatnonzero((at < count) & (positions[np.minimum(at, count - 1)] == positions - length)):
                exact.setdefault(int(j), []).append(int(at[j]))
    p, price = positions.tolist(), prices.tolist()
    cost, back = [0] * count, [0] * count
    queue, head, value = [], 0, []
    for j in range(1, count):
        v = cost[j - 1] + p[j - 1]
        while len(queue) > head and value[-1] >= v:
            queue.pop()
            value.pop()
        queue.append(j - 1)
        value.append(v)
        reach = p[j] - size
        while p[queue[head]] < reach:
            head += 1
        origin, best = queue[head], value[head] + size - p[j]
        if j == count - 1 and not last:
            best = min(cost[i] for i in queue[head:])
            origin = next(i for i in queue[head:] if cost[i] == best)
        for i in exact.get(j, ()):
            if cost[i] < best:
                origin, best = i, cost[i]
        cost[j], back[j] = best + price[j], origin
    cuts = [count - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


class Packer:
    """Candidate cuts and the stream of one partition."""

    def __init__(self, path: str, size: int, end_id: int):
        codec = RankCodec.of(path)
        self.size, self.end_id, self.codec = size, end_id, codec
        tokens = codec.vocabulary.bytes_of
        ends = (b".", b"!", b"?", "…".encode(), "。".encode(), "！".encode(), "？".encode())
        self.closes = np.array([t.endswith(ends) for t in tokens])
        self.breaks = np.array([t.endswith(b"\n") for t in tokens])
        self.spaced = np.array([t[:1] in (b" ", b"\n") for t in tokens])

    def encode(self, text: str | None) -> np.ndarray:
        return np.append(self.codec.encode(text), np.uint32(self.end_id)).astype("<u4")

    def candidates(self, ids: np.ndarray, doc_ends: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
        total = len(ids)
        price = np.full(total + 1, -1, np.int64)
        if last:  # near the end any place may do, so that the rest fills powers of two
            price[max(0, total - self.size) :] = HARD_PRICE
        inner = self.breaks[ids[:-1]] | (self.closes[ids[:-1]] & self.spaced[ids[1:]])
        price[1:total][inner] = SENTENCE_PRICE
        price[doc_ends] = 0
        price[0] = price[total] = 0
        known = np.flatnonzero(price >= 0)
        step = min(HARD_STEP, self.size)
        for low, high in zip(known[:-1], known[1:], strict=True):
            if high - low > step:
                price[low + step : high : step] = HARD_PRICE
        known = np.flatnonzero(price >= 0)
        return known, price[known]


def pack(
    docs: DataFrame, path: str, text: str = "text", size: int = SIZE, end_id: int = END_ID, keep: list[str] | None = None
) -> DataFrame:
    """One row per piece: the kept columns of its document (all but the text by default),
    ``start`` (tokens of the document before it), ``length``, ``ids`` (packed as
    little-endian unsigned 32-bit integers), ``doc_tokens`` (with the closing id),
    ``sequence_id`` and ``offset`` within the sequence."""
    taken = {name for name, _ in PIECE_FIELDS} | {text.lower()}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("_text"))
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(n, t) for n, t in PIECE_FIELDS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(path, size, end_id)
        sequence = TaskContext.get().partitionId() << 33
        rows: pa.Table | None = None  # the documents of the open tokens
        open_ids: list[np.ndarray] = []
        starts: list[int] = []  # tokens of each such document that are packed already
        totals: list[int] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rows, open_ids, starts, totals, sequence
            lengths = np.array([len(x) for x in open_ids])
            ends = np.cumsum(lengths)
            ids = np.concatenate(open_ids)
            positions, prices = packer.candidates(ids, ends, last)
            cuts = positions[choose_cuts(positions, prices, size, last)]
            done = cuts if last else cuts[:-1]
            stop = int(done[-1])
            edges = np.unique(np.concatenate([done, ends[ends < stop], [0]]))
            begin, end = edges[:-1], edges[1:]
            doc = np.searchsorted(ends, begin, "right")
            doc_begin = ends - lengths
            inside = begin - doc_begin[doc]
            number = np.searchsorted(done, begin, "right") - 1
            if len(begin):
                columns = {name: rows.column(n).take(pa.array(doc)) for n, name in enumerate(rows.column_names)}
                columns["start"] = pa.array(np.array(starts)[doc] + inside, pa.int64())
                columns["length"] = pa.array(end - begin, pa.int64())
                columns["ids"] = pa.array([ids[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary())
                columns["doc_tokens"] = pa.array(np.array(totals)[doc], pa.int64())
                columns["sequence_id"] = pa.array(sequence + number, pa.int64())
                columns["offset"] = pa.array(begin - done[number], pa.int64())
                yield from pa.table(list(columns.values()), names=list(columns)).combine_chunks().to_batches()
            sequence += len(done) - 1
            first = int(np.searchsorted(ends, stop, "right"))
            rows = rows.slice(first).combine_chunks()
            used = max(0, stop - int(doc_begin[first])) if first < len(ends) else 0
            open_ids = [x[used:] if n == 0 else x for n, x in enumerate(open_ids[first:])]
            starts = [s + used if n == 0 else s for n, s in enumerate(starts[first:])]
            totals = totals[first:]

        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            held = pa.table([batch.column(n) for n in range(len(kept))], names=batch.schema.names[:-1])
            if not kept:
                held = pa.table([pa.nulls(len(texts))], names=["_row"])
            for low, high in text_groups(texts):
                new = [packer.encode(x) for x in texts[low:high]]
                part = held.slice(low, high - low)
                rows = part if rows is None else pa.concat_tables([rows, part])
                open_ids += new
                starts += [0] * len(new)
                totals += [len(x) for x in new]
                yield from flush(False)
        if open_ids:
            yield from flush(True)

    return source.mapInArrow(tidy(run), schema)
