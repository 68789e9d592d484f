"""Interval-cache algebra: coverage islands and missing gaps (closed intervals)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import ordered_groups
from .temporal import latest_before


def usable_intervals(cache: DataFrame, interval: float, extraction_version: str, preprocessing_version: str) -> DataFrame:
    """Complete entries made with the current settings; all others never count."""
    return cache.filter(
        (F.col("interval") == interval)
        & (F.col("extraction_version") == extraction_version)
        & (F.col("preprocessing_version") == preprocessing_version)
        & F.col("complete")
    )


def merge_intervals(
    intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end", limit: int | None = None
) -> DataFrame:
    """Union of touching or overlapping intervals per key, with member counts."""
    distinct = intervals.groupBy(*keys, F.col(start).alias("start"), F.col(end).alias("end")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    groups = ordered_groups(distinct, keys, ["start", "end"], limit).max_before("_reach", "end")
    opens = F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), 1).otherwise(0)
    islands = groups._next(groups.df.withColumn("_open", opens)).running_sum("_island", "_open").result()
    return islands.groupBy(*keys, "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("_n").alias("n_intervals")
    ).drop("_island")


#: Levels of time nodes; the widest hold 2^LEVELS slots.
LEVELS = 62


def time_nodes(first: Column, last: Column, levels: int = LEVELS) -> Column:
    """The nodes, as ``(level, node)``, that together hold the slots ``first`` to ``last``.

    A node of a level holds two of the level below. Any range is the union of at most two
    nodes a level, so its rows grow with the logarithm of its length.
    """

    def at(level: Column) -> Column:
        half = F.call_function("shiftright", -first, level)
        low, high = -half, F.call_function("shiftright", last + 1, level)
        node = lambda n: F.struct(level.alias("level"), n.alias("node"))
        odd = lambda n: F.pmod(n, F.lit(2)) == 1
        some = low < high
        return F.array(F.when(some & odd(low), node(low)), F.when(some & odd(high), node(high - 1)))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)))


def coverage_gaps(
    islands: DataFrame,
    requests: DataFrame,
    keys: list[str],
    request_id: str = "request_id",
    slot_s: float | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Parts of each requested window ``[start, end]`` that no island covers.

    ``islands`` are disjoint (see :func:`merge_intervals`). The gap before an
    island comes from the island in front of it, the gap at the end from an as-of
    join, so no request meets islands outside its window. A request looks into the few
    nodes of time that make up its window, however long; an island is in one node of each
    level up to that of the longest request.
    """
    mean, longest = requests.agg(F.avg(F.col("end") - F.col("start")), F.max(F.col("end") - F.col("start"))).first()
    slot_s = max(1.0, mean or 1.0) if slot_s is None else slot_s
    levels = min(LEVELS, int((longest or 0.0) // slot_s + 2).bit_length())
    slot = lambda t: F.floor(t / F.lit(float(slot_s))).cast("long")
    asked = requests.select(*keys, request_id, F.col("start").alias("_s"), F.col("end").alias("_e"))
    preceded = ordered_groups(islands, keys, ["start", "end"], limit).lag(_reach="end").result()
    spread = asked.filter("_s <= _e").withColumn("_at", F.explode(time_nodes(slot(F.col("_s")), slot(F.col("_e")), levels))).select("*", "_at.*").drop("_at")
    place = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(slot(F.col("start")), n).alias("node")) for n in range(levels + 1)])
    fronts = preceded.withColumn("_at", F.explode(place)).select("*", "_at.*").drop("_at")
    met = spread.join(fronts, [*keys, "level", "node"]).filter((F.col("start") > F.col("_s")) & (F.col("start") <= F.col("_e")))
    before = met.select(
        *keys, request_id,
        F.greatest("_s", "_reach").alias("gap_start"), F.col("start").alias("gap_end"),
    )
    last = latest_before(asked, islands, keys, "_e", "start", "end", request_id, limit)
    after = last.select(
        *keys, request_id, F.greatest("_s", "end").alias("gap_start"), F.col("_e").alias("gap_end")
    )
    return before.unionByName(after).filter(F.col("gap_end") > F.col("gap_start"))


def covering_island(
    points: DataFrame, islands: DataFrame, keys: list[str], time: str, tie: str, limit: int | None = None
) -> DataFrame:
    """Add ``island_start, island_end, covered`` for each point in time."""
    boxed = islands.select(*keys, "start", F.struct("start", "end").alias("island"))
    found = latest_before(points, boxed, keys, time, "start", "island", tie, limit)
    inside: Column = F.coalesce(F.col(time) <= F.col("island")["end"], F.lit(False))
    return found.select(
        *points.columns,
        F.when(inside, F.col("island")["start"]).alias("island_start"),
        F.when(inside, F.col("island")["end"]).alias("island_end"),
        inside.alias("covered"),
    )
