"""Edge preparation, degrees, components and degree-matched null graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.columns import uniform_of
from kinweave.functions.dealing import dealt, tasks
from kinweave.functions.durable import durable
from kinweave.functions.ordered import placed_in_order
from kinweave.operators.components import of_written

#: Ends of a hub that are numbered at a time.
STUB_BLOCK = 4096


def prepare_edges(edges: DataFrame, directed: bool = False) -> DataFrame:
    """from, to, weight: one row per edge with its greatest weight.

    A column ``weights`` or ``weight`` is used if there is one, else 1. Undirected edges are turned so that
    from <= to. Self-loops stay.
    """
    name = next((c for c in ("weights", "weight") if c in edges.columns), None)
    a, b = F.col("from"), F.col("to")
    if not directed:
        a, b = F.least(a, b), F.greatest(a, b)
    weight = F.col(name).cast("double") if name else F.lit(1.0)
    return edges.select(a.alias("from"), b.alias("to"), weight.alias("weight")).groupBy("from", "to").agg(F.max("weight").alias("weight"))


def adjacency(edges: DataFrame) -> DataFrame:
    """node, neighbour: the distinct neighbours in either direction, without self-loops."""
    both = edges.select(F.col("from").alias("node"), F.col("to").alias("neighbour")).union(edges.select("to", "from"))
    return both.where("node <> neighbour").distinct()


def neighbours(edges: DataFrame, directed: bool = False) -> DataFrame:
    """node, neighbour, weight for walking: both directions of each prepared edge if undirected."""
    prepared = prepare_edges(edges, directed)
    out = prepared.select(F.col("from").alias("node"), F.col("to").alias("neighbour"), "weight")
    return out if directed else out.union(prepared.where("`from` <> `to`").select("to", "from", "weight"))


def node_degree(edges: DataFrame) -> DataFrame:
    """node, degree: edge ends at each node; a self-loop counts twice."""
    return edges.select(F.explode(F.array("from", "to")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def degree_summary(edges: DataFrame) -> DataFrame:
    """Five-number summary and mean of the degrees within each ``type``: type, minimum, q1, median, q3, maximum, mean."""
    degrees = edges.select("type", F.explode(F.array("from", "to")).alias("node")).groupBy("type", "node").agg(F.count(F.lit(1)).alias("degree"))
    at = lambda q, n: F.percentile("degree", F.lit(q)).alias(n)
    return degrees.groupBy("type").agg(
        F.min("degree").alias("minimum"), at(0.25, "q1"), at(0.5, "median"), at(0.75, "q3"), F.max("degree").alias("maximum"), F.avg("degree").alias("mean")
    )


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node with an edge, self-loops included."""
    return _components(durable(edges.select("from", "to")))


def _components(edges: DataFrame) -> DataFrame:
    """`components` of a table that is cheap to read several times."""
    ends = edges.select(F.col("from").alias("a"), F.col("to").alias("b"))
    found = of_written(ends)
    nodes = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the component with the most nodes; of equal ones, that with the smallest node."""
    edges = durable(edges)
    labels = durable(_components(edges))
    largest = labels.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    inside = labels.join(largest, "component", "left_semi").select(F.col("node").alias("from"))
    return dealt(edges, edges.count(), "from").join(inside, "from", "left_semi")


def stubs(edges: DataFrame, directed: bool = False) -> DataFrame:
    """node, stub: one row per edge end (per edge start if directed), without the second end of a self-loop's pair lost."""
    return _stubs(_ends(edges, directed))


def _ends(edges: DataFrame, directed: bool) -> DataFrame:
    """node, degree: edge ends that stubs are made of."""
    ends = edges.select(F.col("from").alias("node")) if directed else edges.select(F.explode(F.array("from", "to")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def _stubs(degrees: DataFrame) -> DataFrame:
    # two levels, so that a hub's ends are never one long array
    blocks = degrees.select("node", "degree", F.explode(F.sequence(F.lit(0), F.floor((F.col("degree") - 1) / STUB_BLOCK))).alias("block"))
    low = F.col("block") * STUB_BLOCK
    return blocks.select("node", F.explode(F.sequence(low + 1, F.least("degree", low + STUB_BLOCK))).alias("stub"))


def largest_components(edges: DataFrame) -> DataFrame:
    """As `largest_component`, of each ``graph`` of ``edges(graph, from, to)`` at once."""
    end = lambda c: F.struct("graph", F.col(c).alias("node")).alias(c)
    labels = durable(components(edges.select(end("from"), end("to"))))
    counts = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("component.graph").agg(F.min(F.struct(-F.col("n"), "component"))["component"].alias("component"))
    inside = labels.join(largest, "component", "left_semi").select("node.graph", F.col("node.node").alias("from"))
    return edges.join(inside, ["graph", "from"], "left_semi")


def configuration_models(edges: DataFrame, seeds: list[int], directed: bool = False) -> DataFrame:
    """Random graphs of about the same degrees, one for each seed: graph (its seed), from, to, weight 1.

    Stubs are ordered by a hash of seed, node and number, and paired in turn; an odd one, self-loops and
    repeated edges are dropped. With ``directed`` only out-degrees are kept. The order is a sort of range partitions, in which
    a row's number says its place, so no task holds all stubs and hashes are shuffled once and never written.
    """
    degrees = durable(_ends(edges, directed))
    n_stubs = (degrees.agg(F.sum("degree")).first()[0] or 0) * len(seeds)
    drawn = _stubs(degrees).withColumn("graph", F.explode(F.array(*[F.lit(s).cast("long") for s in seeds])))
    shuffled = drawn.select("graph", "node", uniform_of(F.col("graph"), F.col("node"), F.col("stub")).alias("u"))
    placed = placed_in_order(shuffled, ["graph"], ["u", "node"], ["node"], "place", tasks(edges, n_stubs)).select(
        "graph", "node", (F.col("place") / 2).cast("long").alias("pair"), (F.col("place") % 2).alias("side")
    )
    paired = dealt(placed, n_stubs, "graph", "pair").groupBy("graph", "pair").agg(
        F.max(F.when(F.col("side") == 0, F.col("node"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("node"))).alias("b")
    )
    kept = paired.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    a, b = (F.col("a"), F.col("b")) if directed else (F.least("a", "b"), F.greatest("a", "b"))
    once = dealt(kept.select("graph", a.alias("from"), b.alias("to")), n_stubs // 2, "graph", "from", "to").distinct()
    return once.withColumn("weight", F.lit(1.0))


def configuration_model(edges: DataFrame, seed: int, directed: bool = False) -> DataFrame:
    """from, to, weight of the random graph that `configuration_models` makes for one seed."""
    return configuration_models(edges, [seed], directed).drop("graph")


def first_of(df: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """Of the rows with equal ``keys`` that of the least ``priority``."""
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(priority)).alias("x"))
    return chosen.select(*keys, *[f"x.{c}" for c in rest])
