"""Connected components of an edge list, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.dealing import dealt
from kinweave.functions.durable import durable


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Labels every node of ``edges(a, b)`` with the smallest node of its component.

    In each level every node is linked to its smallest neighbour. These links, at most one a node, are settled by
    star contractions; then all edges are moved to the components found, in one join an end, and those within a component
    go. What stays has at most half the nodes, and few edges. So a table of many edges a node is passed over twice a level and not
    in each contraction. Only minima are grouped, never a list of neighbours. Nulls and self-loops are ignored; a node that
    has only those is not returned. Empty input gives an empty result. Columns: node, component.
    """
    return of_written(durable(edges.select("a", "b")), max_rounds)


def of_written(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """As `connected_components`, of a table that is cheap to read several times."""
    links, labels = edges.where("a <> b"), None
    for _ in range(max_rounds):
        both = links.select(F.col("a").alias("n"), F.col("b").alias("m")).union(links.select("b", "a"))
        least = both.groupBy("n").agg(F.min("m").alias("m"))
        found = durable(_settled(least.select(F.greatest("n", "m").alias("hi"), F.least("n", "m").alias("lo")).distinct(), max_rounds))
        to = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))  # noqa: E731, B023
        # of the ends b of a component each is kept once, before they are looked up
        half = dealt(links, links.count(), "a").join(to("a"), "a").select("ca", "b").distinct()
        links = durable(half.join(to("b"), "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
        if labels is None:
            labels = found
        else:
            moved = found.select(F.col("node").alias("component"), F.col("component").alias("last"))
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("last", "component").alias("component"))
        if links.isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} levels")


def _settled(pairs: DataFrame, max_rounds: int) -> DataFrame:
    """node, component of ``pairs(hi, lo)``: two star contractions in turn, until no pair changes.

    The number of rounds grows with the logarithm of the longest path.
    """
    pairs = durable(pairs)
    before = None
    for _ in range(max_rounds):
        pairs = durable(_small_star(_large_star(pairs)))
        now = pairs.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node of its neighbourhood."""
    both = pairs.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(pairs.select("lo", "hi"))
    least = both.groupBy("n").agg(F.min("m").alias("least"))
    least = least.select("n", F.least("n", "least").alias("least"))
    return (
        both.where(F.col("m") > F.col("n"))
        .join(least, "n")
        .select(F.col("m").alias("hi"), F.col("least").alias("lo"))
        .distinct()
    )


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = pairs.groupBy("hi").agg(F.min("lo").alias("least"))
    linked = pairs.join(least, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return (
        linked.union(least.select("hi", F.col("least")))
        .where(F.col("hi") != F.col("lo"))
        .distinct()
    )
