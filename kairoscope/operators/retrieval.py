"""Exact and approximate nearest-frame retrieval.

Scores are a matrix product per Arrow batch inside the scan's own tasks. A first pass
over the beginnings of some tasks' shares finds a score that the k-th best frame of each
query reaches at least; the scan sends only frames at or above it, and no more than ``k``
a query and task. What leaves the scan so depends on ``k`` and the sample's share of the
frames, not on the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

HIT_SCHEMA = (
    "query_id string, frame_id string, video_id string, media_type string, timestamp double, "
    "raw_similarity double, score double, matched_component int"
)
CARRIED = ("frame_id", "video_id", "media_type", "timestamp")
#: Query components times frames that are scored at once; a task holds some 60 bytes for each.
PAIR_BUDGET = 500_000
#: As many in the coded search, which picks its candidates from each such share of the frames.
CODE_BUDGET = 4_000_000
#: Rows of one query that a task of the first merge should get.
MERGE_ROWS = 100_000
#: Queries are sent to the tasks in batches of at most so many bytes of vectors.
BATCH_BYTES = 32 << 20
#: Component rows a batch may have besides.
BROADCAST_ROWS = 16_384
#: Tables of up to so many frames are searched without floors.
SAMPLE_FROM = 100_000
#: For the floors about so many tasks score their first rows.
SAMPLE_TASKS = 256
SAMPLE_ROWS = 16_384
#: Frames that a task of the scan holds at least, to estimate the number of tasks.
TASK_ROWS = 50_000
# Scores are compared at 12 decimals so that equal vectors tie whatever block they sit in.
SCORE_DIGITS = 12


class QueryBlock:
    """Query components of one block as a matrix, grouped by query."""

    def __init__(self, table: pa.Table, boost: float):
        ids = table.column("query_id").to_numpy(zero_copy_only=False).astype(object)
        component = table.column("component").to_numpy().astype(np.int64)
        order = np.lexsort((component, ids.astype(str)))
        matrix = _matrix(table.column("embedding").combine_chunks())[order]
        self.matrix = _unit(matrix)
        self.component = component[order]
        self.ids, self.starts = np.unique(ids[order].astype(str), return_index=True)
        self.lengths = np.diff(np.append(self.starts, len(order)))
        several = np.repeat(self.lengths > 1, self.lengths)
        self.weights = np.where(several & (self.component == 0), boost, 1.0)


def _matrix(vectors: pa.Array) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = len(vectors)
    if n == 0:
        return np.zeros((0, 0))
    lengths = np.diff(vectors.offsets.to_numpy())
    if vectors.null_count or (lengths != lengths[0]).any():
        raise ValueError("vectors of one index must share one dimension")
    return flat.reshape(n, -1)


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


class LocalBest:
    """Best ``k`` rows per query seen by one task: by score, then frame id."""

    def __init__(self, block: QueryBlock, k: int, min_similarity: float, method: str, floor: np.ndarray | None = None):
        self.block, self.k, self.min_similarity, self.method = block, k, min_similarity, method
        self.floor = np.full(len(block.ids), -np.inf) if floor is None else floor.copy()
        self.parts: list[tuple] = []
        self.pending = 0

    def add(self, batch: pa.RecordBatch, wanted: np.ndarray | None = None) -> None:
        """Take in a batch; only the (query, row) pairs that are ``wanted``, if given."""
        if wanted is not None:  # rows that no query wants are not scored
            rows = np.flatnonzero(wanted.any(axis=0))
            batch, wanted = batch.take(pa.array(rows)), wanted[:, rows]
        step = max(1, PAIR_BUDGET // max(1, len(self.block.component)))
        for at in range(0, batch.num_rows, step):
            self._add(batch.slice(at, step), None if wanted is None else wanted[:, at : at + step])
            if self.pending > 4 * self.k * len(self.block.ids) + 100_000:
                self._compact()

    def _add(self, batch: pa.RecordBatch, wanted: np.ndarray | None) -> None:
        b = self.block
        vectors = _matrix(batch.column("embedding"))
        if vectors.shape[1] != b.matrix.shape[1]:
            raise ValueError("query and frame vectors differ in dimension")
        raw = b.matrix @ _unit(vectors).T
        shifted = (raw + 1.0) / 2.0
        weighted = np.round(shifted * b.weights[:, None], SCORE_DIGITS)
        best = np.maximum.reduceat(weighted, b.starts, axis=0)
        if self.method == "sum":
            score = np.round(np.add.reduceat(weighted, b.starts, axis=0), SCORE_DIGITS)
        else:
            score = best
        # First component that reaches the best value of its query.
        reached = weighted == np.repeat(best, b.lengths, axis=0)
        position = np.where(reached, np.arange(len(b.component))[:, None], len(b.component))
        winner = np.minimum.reduceat(position, b.starts, axis=0)
        if self.min_similarity > 0:
            score = np.where(
                np.take_along_axis(shifted, winner, axis=0) >= self.min_similarity, score, -np.inf
            )
        if wanted is not None:
            score = np.where(wanted, score, -np.inf)
        # k rows of this block reach the block's k-th best, so nothing below it can be among the best k.
        if score.shape[1] > self.k:
            at = score.shape[1] - self.k
            self.floor = np.maximum(self.floor, np.partition(score, at, axis=1)[:, at])
        keep = (score >= self.floor[:, None]) & (score > -np.inf)
        q, r = np.nonzero(keep)
        if not len(q):
            return
        won = winner[q, r]
        carried = [batch.column(c).take(pa.array(r)).to_numpy(zero_copy_only=False) for c in CARRIED]
        self.parts.append((q, score[q, r], raw[won, r], b.component[won], *carried))
        self.pending += len(q)

    def _compact(self) -> tuple:
        cols = [np.concatenate(c) for c in zip(*self.parts)]
        order = np.lexsort((cols[4].astype(str), -cols[1], cols[0]))
        cols = [c[order] for c in cols]
        first = np.searchsorted(cols[0], cols[0], side="left")
        rank = np.arange(len(order)) - first
        full = rank == self.k - 1
        self.floor[cols[0][full]] = np.maximum(self.floor[cols[0][full]], cols[1][full])
        cols = [c[rank < self.k] for c in cols]
        self.parts, self.pending = [tuple(cols)], len(cols[0])
        return tuple(cols)

    def result(self) -> pa.RecordBatch | None:
        if not self.parts:
            return None
        q, score, raw, component, frame, video, kind, ts = self._compact()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.block.ids[q].tolist(), pa.string()),
                pa.array(frame.tolist(), pa.string()),
                pa.array(video.tolist(), pa.string()),
                pa.array(kind.tolist(), pa.string()),
                pa.array(ts.astype(np.float64)),
                pa.array(raw),
                pa.array(score),
                pa.array(component.astype(np.int32)),
            ],
            names=[f.split()[0] for f in HIT_SCHEMA.split(", ")],
        )


def _rank(hits: DataFrame, k: int, parts: int) -> DataFrame:
    """Global best ``k`` per query; a first round merges ``parts`` shares of a query's rows."""
    by = [F.desc("score"), F.asc("frame_id")]
    if parts > 1:
        part = Window.partitionBy("query_id", "_salt").orderBy(*by)
        salted = hits.withColumn("_salt", F.pmod(F.hash("frame_id"), F.lit(parts))).withColumn("_r", F.row_number().over(part))
        hits = salted.filter(F.col("_r") <= k).drop("_salt", "_r")
    whole = Window.partitionBy("query_id").orderBy(*by)
    return hits.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)


def _components(queries: DataFrame) -> DataFrame:
    component = F.col("component") if "component" in queries.columns else F.lit(0)
    return queries.select(
        F.col("query_id").cast("string").alias("query_id"),
        component.cast("int").alias("component"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 50,
    *,
    min_similarity: float = 0.0,
    method: str = "max",
    boost: float = 1.2,
    batch_bytes: int = BATCH_BYTES,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Exact ``k`` nearest frames per query.

    ``queries``: ``query_id, embedding`` and optionally ``component`` (0 = the full
    query); several components of a query are fused per frame by ``method``, the
    full query weighted by ``boost``. Queries go to the scan's tasks in batches of bounded
    bytes, one scan of the vectors each; the vectors are never shuffled.
    """
    source = vectors.select(*CARRIED, "embedding").filter(F.col("embedding").isNotNull())
    hits, rows = None, None
    for table in _query_batches(_components(queries), batch_bytes, broadcast_rows):
        block = QueryBlock(table, boost)
        rows = vectors.count() if rows is None else rows
        part = _scan(source, block, k, min_similarity, method, rows)
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return source.sparkSession.createDataFrame([], HIT_SCHEMA + ", rank int")
    return hits


def _query_batches(comps: DataFrame, batch_bytes: int, rows: int) -> Iterator[pa.Table]:
    """Whole queries, at most so many bytes of vectors and rows at a time, one batch at the driver."""
    head = comps.limit(rows + 1).toArrow()
    if head.num_rows == 0:
        return
    width = 8 * max(1, len(head.column("embedding")[0]) if head.column("embedding")[0].is_valid else 1)
    if head.num_rows <= rows and head.num_rows * width <= batch_bytes:
        yield head
        return
    staged = stage(comps, "queries")
    batches = -(-2 * staged.count() // max(1, min(rows, batch_bytes // width)))
    for n in range(batches):
        table = staged.filter(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == n).toArrow()
        if table.num_rows:
            yield table


def _scan(source: DataFrame, block: QueryBlock, k: int, min_similarity: float, method: str, rows: int) -> DataFrame:
    context = source.sparkSession.sparkContext
    shared = context.broadcast((block, _floors(source, block, k, min_similarity, method, rows)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, floor = shared.value
        best = LocalBest(queries, k, min_similarity, method, floor)
        for batch in batches:
            best.add(batch)
        out = best.result()
        if out is not None:
            yield out

    # At most k rows a query from each task, if every frame ties with the floor.
    return _rank(source.mapInArrow(scan, HIT_SCHEMA), k, _parts(k, rows, context.defaultParallelism))


def _parts(k: int, rows: int, least: int) -> int:
    """Shares of a query's rows for the first merge, from the number of scan tasks."""
    return -(-k * max(least, rows // TASK_ROWS) // MERGE_ROWS)


def _floors(source: DataFrame, block: QueryBlock, k: int, min_similarity: float, method: str, rows: int) -> np.ndarray:
    """A score per query that at least ``k`` frames reach: the k-th best of some of the frames.

    Any ``k`` frames of the source prove the bound, so a task takes the first rows of its share and
    reads no further, and of very many tasks only some take part.
    """
    floors = np.full(len(block.ids), -np.inf)
    if rows <= SAMPLE_FROM:
        return floors
    context = source.sparkSession.sparkContext
    shared, share = context.broadcast(block), SAMPLE_TASKS / max(1, rows // TASK_ROWS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (TaskContext.get().partitionId() * 0.6180339887498949) % 1 >= share:
            return
        best, left = LocalBest(shared.value, k, min_similarity, method), SAMPLE_ROWS
        for batch in batches:
            best.add(batch.slice(0, left))
            left -= batch.num_rows
            if left <= 0:
                break
        out = best.result()
        if out is not None:
            yield out.select(["query_id", "score"])

    scores = source.mapInArrow(scan, "query_id string, score double")
    in_order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    last = scores.withColumn("_r", F.row_number().over(in_order)).filter(F.col("_r") <= k).filter(F.col("_r") == k)
    found = last.select("query_id", "score").toArrow()
    at = {query: n for n, query in enumerate(block.ids.tolist())}
    for query, score in zip(found.column("query_id").to_pylist(), found.column("score").to_pylist(), strict=True):
        floors[at[query]] = score
    return floors


# --- approximate retrieval: short codes in the cells near a query, then exact scores -----

#: Vectors the centres and code books are fitted on, at most.
FIT_ROWS = 20_000
#: Parts of a vector that are coded by a byte each.
CODE_PARTS = 16
FIT_ROUNDS = 8
#: Best frames by code that are scored exactly, as a multiple of ``k``.
RESCORE = 4


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The closest centre of each row."""
    return np.argmin((centres * centres).sum(1) - 2 * rows @ centres.T, axis=1)


def _centres(rows: np.ndarray, count: int, rounds: int) -> np.ndarray:
    """Centres of a bounded sample by repeated means; the first rows begin."""
    centres = rows[: min(count, len(rows))].copy()
    for _ in range(rounds):
        home = _nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, rows)
        members = np.bincount(home, minlength=len(centres))
        centres = np.where(members[:, None] > 0, sums / np.maximum(members, 1)[:, None], centres)
    return centres


class Codebook:
    """Two levels of centres: cells of whole unit vectors, and 256 centres for each part of what is left."""

    def __init__(self, sample: np.ndarray, n_cells: int, parts: int = CODE_PARTS, rounds: int = FIT_ROUNDS):
        sample = _unit(sample)
        self.cells = _centres(sample, n_cells, rounds)
        rest = sample - self.cells[_nearest(sample, self.cells)]
        self.bounds = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int)
        self.books = [_centres(rest[:, a:b], 256, rounds) for a, b in zip(self.bounds, self.bounds[1:])]

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code, a byte for each part, of each vector."""
        unit = _unit(vectors)
        home = _nearest(unit, self.cells)
        rest = unit - self.cells[home]
        parts = [_nearest(rest[:, a:b], book) for a, b, book in zip(self.bounds, self.bounds[1:], self.books)]
        return home, np.stack(parts, 1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """What each cell and each code byte adds to the cosine of each query."""
        return queries @ self.cells.T, [queries[:, a:b] @ book.T for a, b, book in zip(self.bounds, self.bounds[1:], self.books)]


def fit_codebook(vectors: DataFrame, n_cells: int, parts: int = CODE_PARTS, rows: int = FIT_ROWS) -> Codebook:
    """A code book from at most ``rows`` vectors, drawn by a hash of their ids."""
    drawn = vectors.filter(F.col("embedding").isNotNull()).select(F.md5("frame_id").alias("_h"), "frame_id", "embedding").orderBy("_h", "frame_id").limit(rows)
    sample = _matrix(drawn.select("embedding").toArrow().column("embedding").combine_chunks())
    if not len(sample):
        raise ValueError("no vectors to fit on")
    return Codebook(sample, n_cells, parts)


def index_vectors(vectors: DataFrame, book: Codebook) -> DataFrame:
    """Every frame with its ``cell_id`` and ``code``; write it partitioned by cell to serve searches."""
    source = vectors.select(*CARRIED, "embedding").filter(F.col("embedding").isNotNull())
    shared = source.sparkSession.sparkContext.broadcast(book)
    schema = source.withColumn("code", F.lit(b"")).withColumn("cell_id", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, codes = shared.value.encode(_matrix(batch.column("embedding")))
            rows = [row.tobytes() for row in codes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary()), pa.array(home.astype(np.int32))], schema.names)

    return source.mapInArrow(run, schema)


def approx_top_k(
    index: DataFrame,
    queries: DataFrame,
    book: Codebook,
    k: int = 50,
    n_probe: int = 4,
    method: str = "max",
    boost: float = 1.2,
    rescore: int = RESCORE,
    batch_bytes: int = BATCH_BYTES,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``k`` nearest frames among each query's ``n_probe`` nearest cells.

    Only the folders of probed cells are read. A task adds up what a frame's cell and code
    bytes contribute to each query, and scores its best ``rescore * k`` frames a query exactly, in
    place: only scores leave it. A query of several components visits the cells near
    any of them, and all its components are fused as in :func:`top_k`.
    """
    hits = None
    for table in _query_batches(_components(queries), batch_bytes, broadcast_rows):
        block = QueryBlock(table, boost)
        near, lookups = book.tables(block.matrix)
        probed = np.zeros((len(block.ids), near.shape[1]), bool)
        owner = np.repeat(np.arange(len(block.ids)), block.lengths)
        best = np.argsort(-np.round(near, SCORE_DIGITS), axis=1, kind="stable")[:, :n_probe]
        probed[owner[:, None], best] = True
        cells = np.flatnonzero(probed.any(axis=0)).tolist()  # at most as many as the code book has
        part = _scan_codes(index.filter(F.col("cell_id").isin(cells)), block, near, lookups, probed, k, rescore * k, method)
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return index.sparkSession.createDataFrame([], HIT_SCHEMA + ", rank int")
    return hits


def _scan_codes(
    index: DataFrame, block: QueryBlock, near: np.ndarray, lookups: list[np.ndarray], probed: np.ndarray, k: int, tries: int, method: str
) -> DataFrame:
    source = index.select(*CARRIED, "embedding", "code", F.col("cell_id").cast("int").alias("cell_id"))
    context = source.sparkSession.sparkContext
    shared = context.broadcast((block, near, lookups, probed))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, near, lookups, probed = shared.value
        local = LocalBest(block, k, 0.0, method)
        step = max(1, CODE_BUDGET // max(1, len(block.component)))
        for whole in batches:
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                cell = batch.column("cell_id").to_numpy()
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                guess = near[:, cell]
                for part, table in enumerate(lookups):
                    guess += table[:, codes[:, part]]
                score = (guess + 1) / 2 * block.weights[:, None]
                fused = (np.maximum if method == "max" else np.add).reduceat(score, block.starts, axis=0)
                fused = np.where(probed[:, cell], fused, -np.inf)
                if fused.shape[1] > tries:
                    floor = np.partition(fused, -tries, axis=1)[:, -tries]
                    fused = np.where(fused >= floor[:, None], fused, -np.inf)
                local.add(batch, fused > -np.inf)
        out = local.result()
        if out is not None:
            yield out

    return _rank(source.mapInArrow(scan, HIT_SCHEMA), k, _parts(k, 0, context.defaultParallelism))
