"""Connected components of a link table by alternating star operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage


def _large(links: DataFrame) -> DataFrame:
    """Hang the larger neighbours of every node on its smallest neighbour."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(least, "a").filter(F.col("b") > F.col("a"))
    return joined.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a != b").distinct()


def _small(links: DataFrame) -> DataFrame:
    """Hang the smaller neighbours of every node, and the node, on the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links ``a``, ``b`` that is not its own root.

    The root is the smallest node of the component. Nothing is collected: each round
    aggregates, joins and writes the links to the shared folder; rounds grow with the
    logarithm of the longest path. Both sides of the joins are plain exchanges, so
    runtime skew handling splits a node with very many links.
    """
    links = stage(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        links = stage(_small(_large(links)), "links")
        # The state is final when another round leaves the same links.
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(now)


#: How many times more members of a bucket are compared with the rest in each further round.
WIDEN = 64


Test = Callable[[Column, Column], Column]


def linked(
    shared: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    admit: Test | None = None,
    facts: Callable[[DataFrame], DataFrame] | None = None,
    bound: Test | None = None,
) -> DataFrame:
    """(node, root) of the classes that verified links make among nodes sharing buckets.

    ``shared`` holds (bucket, c, size) with the number of nodes in the bucket and any
    columns that ``admit``, a cheap test of two members, reads from its two structs;
    ``verify`` returns those of the pairs (a, b) that are linked. ``facts`` may compute
    columns of the members (c) still open after the first round, from which ``bound`` tells
    pairs that can't be linked without a comparison.

    No bucket is expanded into all pairs from the start. First the most popular member,
    the one in most and largest buckets, is compared with the rest of its bucket. A
    bucket whose members are one component is done. In the others ``WIDEN`` times more
    members in each round, picked by a hash, are compared with the members of other
    components, until all of them have been: a pair is left out only when both sides
    are in one component already, so no component can differ from that of all pairs.
    A pair that shares several buckets is taken up in the smallest of them only; a node
    carries the list of its buckets, of which there are as many as the caller places.
    """
    extra = [c for c in shared.columns if c not in ("bucket", "c", "size")]
    popular = shared.groupBy("c").agg(F.sum(F.log2("size")).alias("popular"))
    leader = F.max_by(F.struct("c", *extra), F.struct("popular", "c"))
    leaders = shared.join(popular, "c").groupBy("bucket").agg(leader.alias("lead"))

    def pairs_of(joined: DataFrame, tests: list[Test | None], columns: list[str]) -> DataFrame:
        joined = joined.filter(F.col("lead.c") != F.col("c"))
        for test in tests:
            if test is not None:
                joined = joined.filter(test(F.col("lead"), F.struct("c", *columns)))
        return joined.select(F.least("lead.c", "c").alias("a"), F.greatest("lead.c", "c").alias("b")).distinct()

    found = components(stage(verify(pairs_of(shared.join(leaders, "bucket"), [admit], extra)), "verified"))
    members, shares = shared, []
    led_by = lambda share: F.pmod(F.xxhash64("c"), F.greatest(F.lit(1), F.floor(F.col("size") / share))) == 0
    while True:
        members = members.drop("root").join(found.withColumnRenamed("node", "c"), "c", "left")
        members = members.withColumn("root", F.coalesce("root", "c"))
        mixed = members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
        members = stage(members.join(mixed.select("bucket"), "bucket"), "members")
        if members.isEmpty():
            return found
        if not shares:
            open_ = members.select("c").distinct()
            known = shared.join(open_, "c").groupBy("c").agg(F.collect_list("bucket").alias("homes"))
            if facts is not None:
                known = known.join(facts(open_), "c")
            extra += [c for c in known.columns if c != "c"]
            members = stage(members.join(known, "c"), "members")
        # About ``share`` members of a bucket lead; all of them in buckets of less than twice that size.
        # Who led in an earlier round has been compared with all members of the bucket.
        fresh = members
        for share in shares:
            fresh = fresh.filter(~led_by(share))
        shares.append(WIDEN * (shares[-1] if shares else 1))
        marked = fresh.withColumn("leads", led_by(shares[-1]))
        lead = marked.filter("leads").select(F.col("bucket").alias("place"), F.struct("c", *extra).alias("lead"), F.col("root").alias("lead_root"))
        once = ~F.col("leads") | (F.col("lead.c") < F.col("c"))
        first_home = F.array_min(F.array_intersect("lead.homes", "homes")) == F.col("bucket")
        joined = marked.join(lead, F.col("bucket") == F.col("place")).filter((F.col("root") != F.col("lead_root")) & once & first_home)
        new = stage(verify(pairs_of(joined, [admit, bound], extra)), "verified")
        if not new.isEmpty():
            found = components(new.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        members = members.filter(F.floor(F.col("size") / shares[-1]) > 1)
