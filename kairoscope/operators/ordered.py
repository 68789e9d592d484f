"""Windows over (key, order) that stay balanced when one key is huge.

A plain window sends all rows of a key to one task. Keys above a row limit are
cut into chunks of consecutive rows instead: only their rows are range
partitioned by (key, order) and staged, so a chunk is a bounded run and chunk
numbers follow the order. Windows then run per (key, chunk) and one small row
per chunk carries the missing history across the cut. With no such key the plan
is the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

CHUNK = "_chunk"
MIN_LIMIT = 1_000_000
MAX_HOT_KEYS = 200_000


def _same(left: list[str], right: list[str]) -> Column:
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


@dataclass(frozen=True)
class OrderedGroups:
    """Rows grouped by ``keys`` and totally ordered by ``order`` within a key."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    split: bool

    @property
    def _group(self) -> list[str]:
        return [*self.keys, CHUNK]

    @property
    def _window(self):
        return Window.partitionBy(*self._group).orderBy(*self.order)

    def _edges(self, *aggs: Column) -> DataFrame:
        """One row per (hot key, chunk); the count is bounded by chunks + hot keys."""
        return self.df.filter(F.col(CHUNK) >= 0).groupBy(*self._group).agg(*aggs)

    def _with_carry(self, edges: DataFrame, carried: dict[str, Column]) -> DataFrame:
        """Join what earlier chunks of the same key pass on."""
        w = Window.partitionBy(*self.keys).orderBy(CHUNK)
        names = [f"_g{i}" for i in range(len(self._group))]
        carry = edges.select(
            *[F.col(g).alias(n) for g, n in zip(self._group, names)],
            *[c(w).alias(n) for n, c in carried.items()],
        )
        # Bounded by construction: at most one row per chunk and hot key.
        return self.df.join(F.broadcast(carry), _same(self._group, names), "left").drop(*names)

    def _next(self, df: DataFrame) -> "OrderedGroups":
        return replace(self, df=df)

    def lag(self, **columns: str) -> "OrderedGroups":
        """Add ``name=column`` pairs holding the previous row's value."""
        df, w = self.df, self._window
        if self.split:
            tail = F.max_by(F.struct(*columns.values()), F.struct(*self.order)).alias("_tail")
            df = self._with_carry(self._edges(tail), {"_prev": lambda cw: F.lag("_tail").over(cw)})
            df = df.withColumn("_rn", F.row_number().over(w))
        for name, column in columns.items():
            value = F.lag(column).over(w)
            if self.split:
                value = F.when(F.col("_rn") == 1, F.col("_prev")[column]).otherwise(value)
            df = df.withColumn(name, value)
        return self._next(df.drop("_prev", "_rn"))

    def running_sum(self, name: str, column: str) -> "OrderedGroups":
        """Add the sum of ``column`` up to and including the row."""
        local = F.sum(column).over(self._window.rowsBetween(Window.unboundedPreceding, 0))
        if not self.split:
            return self._next(self.df.withColumn(name, local))
        before = lambda cw: F.sum("_total").over(cw.rowsBetween(Window.unboundedPreceding, -1))
        df = self._with_carry(self._edges(F.sum(column).alias("_total")), {"_base": before})
        df = df.withColumn(name, F.coalesce(local + F.col("_base"), local, F.col("_base")))
        return self._next(df.drop("_base"))

    def max_before(self, name: str, column: str) -> "OrderedGroups":
        """Add the maximum of ``column`` over all earlier rows (null on the first)."""
        local = F.max(column).over(self._window.rowsBetween(Window.unboundedPreceding, -1))
        if not self.split:
            return self._next(self.df.withColumn(name, local))
        before = lambda cw: F.max("_top").over(cw.rowsBetween(Window.unboundedPreceding, -1))
        df = self._with_carry(self._edges(F.max(column).alias("_top")), {"_base": before})
        return self._next(df.withColumn(name, F.greatest(local, "_base")).drop("_base"))

    def last_known(self, name: str, column: str) -> "OrderedGroups":
        """Add the latest non-null ``column`` up to and including the row."""
        local = F.last(column, ignorenulls=True).over(self._window.rowsBetween(Window.unboundedPreceding, 0))
        if not self.split:
            return self._next(self.df.withColumn(name, local))
        known = F.when(F.col(column).isNotNull(), F.struct(*self.order))
        before = lambda cw: F.last("_seen", ignorenulls=True).over(
            cw.rowsBetween(Window.unboundedPreceding, -1)
        )
        df = self._with_carry(self._edges(F.max_by(column, known).alias("_seen")), {"_base": before})
        return self._next(df.withColumn(name, F.coalesce(local, "_base")).drop("_base"))

    def trailing(self, rows: int, **aggs: Column) -> "OrderedGroups":
        """Add aggregates over the row and its ``rows - 1`` predecessors."""
        frame = self._window.rowsBetween(-(rows - 1), 0)
        df = self.df
        if self.split:
            halo = self._halo(rows - 1)
            df = df.withColumn("_own", F.lit(True)).unionByName(halo.withColumn("_own", F.lit(False)))
        for name, agg in aggs.items():
            df = df.withColumn(name, agg.over(frame))
        if self.split:
            df = df.filter("_own").drop("_own")
        return self._next(df)

    def _halo(self, rows: int) -> DataFrame:
        """The ``rows`` rows before each chunk of a hot key, relabelled to that chunk."""
        hot = self.df.filter(F.col(CHUNK) >= 0)
        backwards = Window.partitionBy(*self._group).orderBy(*[F.desc(c) for c in self.order])
        tails = hot.withColumn("_back", F.row_number().over(backwards)).filter(F.col("_back") <= rows)
        along = Window.partitionBy(*self.keys).orderBy(*self.order)
        tails = tails.withColumn("_pos", F.row_number().over(along)).drop("_back")
        ends = tails.groupBy(*self._group).agg(F.max("_pos").alias("_end"))
        step = Window.partitionBy(*self.keys).orderBy(CHUNK)
        targets = ends.select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)],
            F.lead(CHUNK).over(step).alias("_to"),
            F.col("_end").alias("_at"),
        ).filter(F.col("_to").isNotNull())
        reach = tails.withColumn("_e", F.explode(F.sequence(F.col("_pos"), F.col("_pos") + (rows - 1))))
        on = _same([*self.keys, "_e"], [*[f"_k{i}" for i in range(len(self.keys))], "_at"])
        moved = reach.join(targets, on).withColumn(CHUNK, F.col("_to"))
        return moved.select(*self.df.columns)

    def result(self) -> DataFrame:
        return self.df.drop(CHUNK)


def row_limit(total: int, limit: int | None) -> int:
    """Rows one task may hold; grows with the table so hot keys stay countable."""
    if limit is not None:
        return max(2, limit)
    return max(MIN_LIMIT, total // MAX_HOT_KEYS)


def ordered_groups(df: DataFrame, keys: list[str], order: list[str], limit: int | None = None) -> OrderedGroups:
    """Prepare ``df`` for ordered windows; reads the key columns once to find hot keys.

    ``order`` must be total within a key. At most ``total / limit`` keys can be
    hot, which bounds the list that is broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    spread = counts.agg(F.sum("_n").alias("total"), F.max("_n").alias("top")).first()
    total, top = spread["total"] or 0, spread["top"] or 0
    bound = row_limit(total, limit)
    if top <= bound:
        return OrderedGroups(df.withColumn(CHUNK, F.lit(-1)), keys, order, False)
    names = [f"_h{i}" for i in range(len(keys))]
    hot = stage(
        counts.filter(F.col("_n") > bound).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "_n"),
        "hot-keys",
    )
    hot_rows = hot.agg(F.sum("_n")).first()[0]
    on = _same(keys, names)
    chunks = max(2, ceil(2 * hot_rows / bound))
    spread_out = (
        df.join(F.broadcast(hot), on, "left_semi")
        .repartitionByRange(chunks, *keys, *order)
        .withColumn(CHUNK, F.spark_partition_id())
    )
    cold = df.join(F.broadcast(hot), on, "left_anti").withColumn(CHUNK, F.lit(-1))
    return OrderedGroups(cold.unionByName(stage(spread_out, "chunks")), keys, order, True)
