"""Synthetic graphs and association data. All draws are hash uniforms of seed and keys."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.functions.columns import padded, uniform
from kinweave.functions.durable import durable
from kinweave.params import SyntheticParams

KINDS = ("barbell", "caveman", "stochastic_block")
#: Genes whose partners are drawn in one task, about; partners that one stream of draws passes over; interactions to expect of a table that is stored, more are drawn anew for each use.
CELL, SPAN, STORED = 256, 1 << 14, 1 << 22


def _numbers(spark: SparkSession, n: int) -> DataFrame:
    """i from 1 to n."""
    return spark.range(1, n + 1).select(F.col("id").alias("i"))


def _part(i: str, size: int):
    return F.floor((F.col(i) - 1) / size).cast("long") + 1


def _clusters(nodes: DataFrame, n: int) -> DataFrame:
    """i and cluster (from 1)."""
    return nodes.select("i", _part("i", n).cast("int").alias("cluster"))


def _pairs_within(nodes: DataFrame) -> DataFrame:
    a = nodes.select(F.col("i").alias("u"), "cluster")
    b = nodes.select(F.col("i").alias("v"), "cluster")
    return a.join(b, "cluster").where("u < v").select("u", "v")


def _named(edges: DataFrame) -> DataFrame:
    return edges.select(padded("node_", F.col("u")).alias("from"), padded("node_", F.col("v")).alias("to"), F.lit("interaction").alias("edge_type"))


def _among(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) of which both are there."""
    for end in ("u", "v"):
        pairs = pairs.join(nodes.select(F.col("i").alias(end)), end, "left_semi")
    return pairs.select("u", "v")


def barbell(nodes: DataFrame, n: int) -> DataFrame:
    """Edges (u, v) over the whole numbers ``nodes(i)`` from 1: each 2 n in a row are two cliques of n, and a bridge from the last of one to the first of the other."""
    bridges = nodes.where((F.col("i") - 1) % (2 * n) == n - 1).select(F.col("i").alias("u"), (F.col("i") + 1).alias("v"))
    return _pairs_within(_clusters(nodes, n)).union(_among(bridges, nodes))


def caveman(nodes: DataFrame, n: int, k: int, p_between: float, seed: int) -> DataFrame:
    """As `barbell`, with k cliques of n in a row; each pair of these gets a random bridge with probability p_between."""
    caves = _clusters(nodes, n).select(F.col("cluster").cast("long").alias("a")).distinct().withColumn("graph", _part("a", k))
    pairs = caves.join(caves.withColumnRenamed("a", "b"), "graph").where("a < b")
    draw = lambda name: uniform(seed, F.lit(name), F.col("a"), F.col("b"))
    place = lambda name, c: ((F.col(c) - 1) * n + 1 + F.floor(draw(name) * n)).cast("long")
    bridges = pairs.where(draw("bridge") < p_between).select(place("left", "a").alias("u"), place("right", "b").alias("v"))
    return _pairs_within(_clusters(nodes, n)).union(_among(bridges, nodes))


def stochastic_block(nodes: DataFrame, n: int, k: int, p_within: float, p_between: float, seed: int) -> DataFrame:
    """As `barbell`, with k blocks of n in a row: each pair of their nodes is an edge with probability p_within or p_between. The pairs are the input by definition."""
    own = _clusters(nodes, n).withColumn("graph", _part("i", n * k))
    pairs = own.select("graph", F.col("i").alias("u"), F.col("cluster").alias("cu")).join(own.select("graph", F.col("i").alias("v"), F.col("cluster").alias("cv")), "graph").where("u < v")
    return pairs.where(uniform(seed, F.col("u"), F.col("v")) < F.when(F.col("cu") == F.col("cv"), p_within).otherwise(p_between)).select("u", "v")


@dataclass(frozen=True)
class TestGraph:
    edges: DataFrame
    node_labels: DataFrame


def node2vec_test_data(
    spark: SparkSession, test_type: str, n_nodes_per_cluster: int = 10, n_clusters: int = 3, p_within: float = 0.8, p_between: float = 0.05, seed: int = 42
) -> TestGraph:
    """edges(from, to, edge_type) and node_labels(node, cluster) of a barbell, caveman or stochastic block graph."""
    kind = {"cavemen": "caveman", "stochastic": "stochastic_block"}.get(test_type.lower(), test_type.lower())
    n, n_clusters = n_nodes_per_cluster, 2 if kind == "barbell" else n_clusters
    return planted(_numbers(spark, n * n_clusters), kind, n, n_clusters, p_within, p_between, seed)


def planted(nodes: DataFrame, kind: str, n: int, k: int, p_within: float = 0.8, p_between: float = 0.05, seed: int = 42) -> TestGraph:
    """Graphs of one of KINDS over the whole numbers ``nodes(i)`` from 1, n times k numbers in a row for each graph, with the labels of its clusters.

    Numbers that are missing leave holes. Edges grow with the nodes, since the size of a graph is fixed.
    """
    if kind == "barbell":
        edges = barbell(nodes, n)
    elif kind == "caveman":
        edges = caveman(nodes, n, k, p_between, seed)
    elif kind == "stochastic_block":
        edges = stochastic_block(nodes, n, k, p_within, p_between, seed)
    else:
        raise ValueError(f"{kind!r} is none of {list(KINDS)}")
    return TestGraph(_named(edges), _clusters(nodes, n).select(padded("node_", F.col("i")).alias("node"), "cluster"))


@dataclass(frozen=True)
class AssociationData:
    full_data: DataFrame
    gene_to_pathways: DataFrame
    gene_ids: DataFrame
    pathway_ids: DataFrame


def association_data(spark: SparkSession, params: SyntheticParams | None = None, seed: int = 42) -> AssociationData:
    """A forest of terms, genes with signal in one subtree, anchor genes in the others, and noise genes across subtrees.

    Signal genes take their terms from the first subtree, anchors from one other subtree each, noise genes one from
    each of the first ``min_noise_subtrees`` subtrees of a random order and the rest from anywhere. Interactions join
    genes of a group with probability p_ppi. full_data(from, to, type), gene_to_pathways(from, to, type), gene_ids(gene),
    pathway_ids(pathway).
    """
    p = params or SyntheticParams()
    terms = durable(_forest(spark, p, seed))
    hierarchy = terms.where("parent IS NOT NULL").select("parent", "term").union(_lateral(terms, p, seed))
    genes = durable(_genes(spark, p))
    annotations = durable(_annotations(genes, terms, p, seed))
    ppi = _interactions(genes, p.p_ppi, seed)
    kinds = [(hierarchy.toDF("from", "to"), "hierarchy"), (annotations.toDF("from", "to"), "part_of"), (ppi.select("u", "v").toDF("from", "to"), "interaction")]
    tagged = [df.withColumn("type", F.lit(kind)) for df, kind in kinds]
    anchors = max(p.n_signal_genes // max(1, p.n_roots - 1), 2)
    expected = p.p_ppi * (p.n_signal_genes**2 + p.n_noise_genes**2 + max(0, p.n_roots - 1) * anchors**2) / 2
    full = tagged[0].union(tagged[1]).union(tagged[2])
    full = durable(full) if expected <= STORED else durable(tagged[0].union(tagged[1])).union(tagged[2])
    part_of = full.where("type = 'part_of'")
    ends = full.where("type = 'interaction'").select(F.explode(F.array("from", "to")).alias("gene"))
    return AssociationData(
        full,
        part_of,
        part_of.select(F.col("from").alias("gene")).union(ends).distinct(),
        full.where("type = 'hierarchy'").select(F.explode(F.array("from", "to")).alias("pathway")).distinct(),
    )


def _interactions(genes: DataFrame, share: float, seed: int) -> DataFrame:
    """u, v: each pair of a crew of ``genes(gene, crew)``, numbered from 1 at the end of their names, with probability ``share``, the lesser name first.

    For each gene the gaps between its partners among the later genes of its crew are drawn, which are geometric: the same distribution as a
    draw for each pair, but work goes with the interactions and not with the pairs. The streams of draws hang on seed, gene and span alone.
    """
    number, sizes = F.regexp_extract("gene", r"(\d+)$", 1).cast("long"), genes.groupBy("crew").agg(F.count(F.lit(1)).alias("last"))
    rows = genes.select("crew", F.regexp_extract("gene", r"^(.*_)\d+$", 1).alias("prefix"), number.alias("u")).join(F.broadcast(sizes), "crew").where("u < last")  # a row a crew
    rows = rows.withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - F.col("u") - 1) / SPAN))))
    begin = F.col("u") + 1 + F.col("span") * SPAN
    rows = rows.select("prefix", "u", begin.alias("begin"), F.least(F.lit(SPAN), F.col("last") - begin + 1).alias("n"), F.xxhash64(F.lit(seed), F.lit("ppi"), "crew", "u", "span").alias("key"))
    parts = max(int(genes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-genes.count() // CELL))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist() if share > 0 else ():
                v = pa.array(row["begin"] + partners(row["key"], row["n"], share))
                name = lambda x, prefix=row["prefix"]: pc.binary_join_element_wise(prefix, pc.utf8_lpad(pc.cast(x, pa.string()), 4, "0"), "")
                left, right = pa.repeat(f"{row['prefix']}{row['u']:04d}", len(v)), name(v)
                lesser = pc.less(left, right)
                yield pa.RecordBatch.from_arrays([pc.if_else(lesser, left, right), pc.if_else(lesser, right, left)], ["u", "v"])

    return rows.repartition(parts, "prefix", "u").mapInArrow(run, "u string, v string")


def partners(key: int, n: int, share: float) -> np.ndarray:
    """Numbers below ``n``, each with probability ``share``."""
    rng, found, last = np.random.Generator(np.random.Philox(key=key & 0xFFFFFFFFFFFFFFFF)), [], -1
    scale = np.log1p(-share) if share < 1 else -np.inf
    while last < n:
        gaps = np.minimum(np.floor(np.log1p(-rng.random(int(share * n + 6 * (share * n) ** 0.5) + 8)) / scale), n) + 1
        found.append(last + np.cumsum(gaps).astype(np.int64))
        last = int(found[-1][-1])
    found = np.concatenate(found)
    return found[found < n]


def _forest(spark: SparkSession, p: SyntheticParams, seed: int) -> DataFrame:
    """term, subtree, level, parent; a term has branching - 1 plus 0 to 2 children. The path of places names a term."""
    level = spark.range(p.n_roots).select(F.col("id").cast("string").alias("path"), F.col("id").cast("int").alias("subtree"), F.lit(None).cast("string").alias("up"))
    out = level.withColumn("level", F.lit(0))
    for depth in range(1, p.depth + 1):
        n = (F.lit(p.branching - 1) + F.floor(uniform(seed, F.lit("children"), F.col("path")) * 3)).cast("int")
        level = level.where(n > 0).select(F.col("path").alias("up"), "subtree", F.explode(F.sequence(F.lit(1), n)).alias("k"))
        level = level.select(F.concat_ws(".", "up", F.col("k").cast("string")).alias("path"), "subtree", "up")
        out = out.unionByName(level.withColumn("level", F.lit(depth)))
    name = lambda c: F.concat(F.lit("term_"), F.col(c))
    return out.select(name("path").alias("term"), "subtree", "level", F.when(F.col("up").isNotNull(), name("up")).alias("parent"))


def _lateral(terms: DataFrame, p: SyntheticParams, seed: int) -> DataFrame:
    a = terms.select(F.col("term").alias("a"), "subtree", "level")
    b = terms.select(F.col("term").alias("b"), "subtree", "level")
    pairs = a.join(b, ["subtree", "level"]).where("a < b")
    return pairs.where(uniform(seed, F.lit("lateral"), F.col("a"), F.col("b")) < p.p_lateral).select("a", "b")


def _genes(spark: SparkSession, p: SyntheticParams) -> DataFrame:
    """gene, crew (whom it interacts with), home (its subtree, -1 for noise)."""
    anchors = max(p.n_signal_genes // max(1, p.n_roots - 1), 2)
    signal = spark.range(1, p.n_signal_genes + 1).select(padded("gene_signal_", F.col("id")).alias("gene"), F.lit("signal").alias("crew"), F.lit(0).alias("home"))
    noise = spark.range(1, p.n_noise_genes + 1).select(padded("gene_noise_", F.col("id")).alias("gene"), F.lit("noise").alias("crew"), F.lit(-1).alias("home"))
    home = F.expr(f"cast(id div {anchors} + 1 as int)")
    other = spark.range(max(0, p.n_roots - 1) * anchors).select(
        F.format_string("gene_anchor_%d_%04d", home, (F.col("id") % anchors + 1)).alias("gene"), F.concat(F.lit("anchor"), home.cast("string")).alias("crew"), home.alias("home")
    )
    return signal.union(other).union(noise)


def _annotations(genes: DataFrame, terms: DataFrame, p: SyntheticParams, seed: int) -> DataFrame:
    """gene, term: draws with replacement, repeats within a gene dropped."""
    span = p.max_annotations - p.min_annotations + 1
    n = (F.lit(p.min_annotations) + F.floor(uniform(seed, F.lit("annotations"), F.col("gene")) * span)).cast("int")
    draws = genes.select("gene", "home", F.posexplode(F.sequence(F.lit(1), n)).alias("draw", "x")).drop("x")
    subtree = (
        F.when(F.col("home") >= 0, F.col("home"))
        .when(F.col("draw") < min(p.min_noise_subtrees, p.n_roots), (F.col("draw") + F.floor(uniform(seed, F.lit("first"), F.col("gene")) * p.n_roots)) % p.n_roots)
        .otherwise(F.floor(uniform(seed, F.lit("subtree"), F.col("gene"), F.col("draw")) * p.n_roots))
        .cast("int")
    )
    # a number below the terms of the subtree is drawn; a race of all its terms took a hash for each of them
    own = Window.partitionBy("subtree").orderBy("term")
    numbered = durable(terms.select("term", "subtree", (F.row_number().over(own) - 1).alias("place"), F.count(F.lit(1)).over(Window.partitionBy("subtree")).alias("n")))
    sizes = numbered.where("place = 0").select("subtree", "n")
    place = F.floor(uniform(seed, F.lit("term"), F.col("gene"), F.col("draw")) * F.col("n")).cast("int").alias("place")
    choices = draws.select("gene", "draw", subtree.alias("subtree")).join(sizes, "subtree").select("gene", "subtree", place)
    return choices.join(numbered.drop("n"), ["subtree", "place"]).select("gene", "term").distinct()
