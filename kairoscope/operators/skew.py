"""Joining per-group values back to rows when a group may be huge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import row_limit

SPREAD = 4096


def attach_group_values(
    rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread_by: str, limit: int | None = None
) -> DataFrame:
    """``rows`` joined with the one ``groups`` row per key, skew-free.

    Groups above the row limit are few - at most total / limit - and are
    broadcast; their rows take no part in the shuffle join but travel under
    filler keys spread by the ``spread_by`` column. Runtime skew joins do not
    cover this case because an aggregate sits between its shuffle and the join.
    """
    bound = row_limit(rows.count(), limit)
    values = [c for c in groups.columns if c not in keys]
    fields = F.struct(*values)
    hot = groups.filter(F.col(size) > bound).select(*keys, fields.alias("_hot"))
    cold = groups.filter(F.col(size) <= bound)
    marked = rows.join(F.broadcast(hot), keys, "left")
    filler = F.when(F.col("_hot").isNotNull(), F.pmod(F.hash(spread_by), F.lit(SPREAD)) + 1).otherwise(F.lit(0))
    left = marked.withColumn("_filler", filler)
    # Always 0, but not a literal: a folded constant would drop out of the join's hash keys.
    zero = F.pmod(F.hash(*keys), F.lit(1))
    right = cold.select(*keys, zero.alias("_filler"), fields.alias("_cold"))
    joined = left.join(right, [*keys, "_filler"], "left")
    found = joined.withColumn("_values", F.coalesce("_hot", "_cold")).filter(F.col("_values").isNotNull())
    return found.select(*rows.columns, "_values.*")
