"""Tables behind the usual plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.columns import uniform
from kinweave.functions.durable import durable
from kinweave.operators import grouped
from kinweave.operators.graph import node_degree

BINS = 50


def histogram(values: DataFrame, bins: int = BINS) -> DataFrame:
    """sample, bin, count, density of ``values(sample, similarity)``; all samples share the range of the data.

    The greatest value lies in the last bin. If all values are equal, the width is 1. NaN and nulls are left out.
    """
    known = durable(values.where(F.col("similarity").isNotNull() & ~F.isnan("similarity")))
    span = known.agg(F.min("similarity").alias("low"), F.max("similarity").alias("high"))
    width = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / bins).otherwise(1.0)
    placed = known.crossJoin(span.select("low", width.alias("width"))).select(
        "sample", "width", F.least(F.floor((F.col("similarity") - F.col("low")) / F.col("width")), F.lit(bins - 1)).cast("int").alias("bin")
    )
    counts = placed.groupBy("sample", "bin", "width").agg(F.count(F.lit(1)).alias("count"))
    totals = known.groupBy("sample").agg(F.count(F.lit(1)).alias("total"))
    return counts.join(totals, "sample").select("sample", "bin", "count", (F.col("count") / (F.col("total") * F.col("width"))).alias("density"))


def group_histogram(genes: DataFrame, pathways: DataFrame, embeddings: DataFrame, null: DataFrame, bins: int = BINS) -> DataFrame:
    """`histogram` of ``null(similarity)`` and, as ``actual``, of the cosines of `stats.group_cosine`, all to nine decimals. The pairs are made twice and never written."""
    found = grouped.groups(genes, pathways, embeddings)
    known = durable(null.where(F.col("similarity").isNotNull() & ~F.isnan("similarity")).select(F.round("similarity", 9).alias("x")))
    spans = [x for x in (known.agg(F.min("x"), F.max("x")).first(), grouped.extremes(found)) if x and x[0] is not None]
    low, high = min([x[0] for x in spans], default=0.0), max([x[1] for x in spans], default=0.0)
    width = (high - low) / bins if high > low else 1.0
    place = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int").alias("bin")
    counts = known.groupBy(F.lit("null").alias("sample"), place).agg(F.count(F.lit(1)).alias("count"))
    counts = durable(counts.union(grouped.binned(found, low, width, bins).select(F.lit("actual"), "bin", "count")))
    totals = counts.groupBy("sample").agg(F.sum("count").alias("total"))
    return counts.join(totals, "sample").select("sample", "bin", "count", (F.col("count") / (F.col("total") * F.lit(width))).alias("density"))


def similarity_plot_data(analysis) -> DataFrame | None:
    """The histogram of each permutation's similarities and of the tested pairs (sample ``actual``)."""
    if analysis.null is None or analysis.statistics is None:
        return None
    null = analysis.null.select(F.concat(F.lit("perm_"), F.col("perm").cast("string")).alias("sample"), "similarity")
    return histogram(null.unionByName(analysis.statistics.select(F.lit("actual").alias("sample"), "similarity")))


def enrichment(statistics: DataFrame, interactions: DataFrame, threshold: float = 0.25) -> DataFrame:
    """gene, ratio (share of its pathways with avg_gene_fdr up to the threshold), connections, degree (0 without interactions)."""
    ratio = F.avg((F.col("avg_gene_fdr") <= threshold).cast("double")).alias("ratio")
    genes = statistics.groupBy("gene").agg(ratio, F.count(F.lit(1)).alias("connections"))
    degree = node_degree(interactions).withColumnRenamed("node", "gene")
    return genes.join(degree, "gene", "left").select("gene", "ratio", "connections", F.coalesce("degree", F.lit(0)).alias("degree"))


def result_plot_data(analysis, threshold: float = 0.25) -> DataFrame | None:
    if analysis.statistics is None:
        return None
    return enrichment(analysis.statistics, analysis.graph.where("type = 'interaction'"), threshold)


def with_labels(table: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """Adds ``<column>_label`` for each of the columns, from ``names(id, label)``; an id without a label shows itself.

    Of several labels of an id the first in order is taken; nulls stay null. A column ``<column>_label`` that is there already is replaced.
    """
    known = names.groupBy("id").agg(F.min("label").alias("label"))
    for c in columns:
        own = known.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
        table = table.drop(f"{c}_label").join(own, c, "left").withColumn(f"{c}_label", F.coalesce(f"{c}_label", c))
    return table


def sample_genes(genes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` random ones of the distinct ``genes(gene)``, all if there are fewer; the same for equal seeds."""
    drawn = genes.select("gene").distinct().withColumn("u", uniform(seed, F.col("gene")))
    return drawn.orderBy("u", "gene").limit(n).select("gene")


def pca_2d(embeddings: DataFrame) -> DataFrame:
    """node, pc1, pc2: the first two components of the scaled embeddings. Each component's sign is that of its largest loading."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = embeddings.select("node", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(rows).transform(rows)
    model = PCA(k=2, inputCol="scaled", outputCol="pc").fit(scaled)
    loadings = model.pc.toArray()
    signs = [float(1 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1) for j in range(2)]
    pc = vector_to_array("pc")
    return model.transform(scaled).select("node", (pc[0] * signs[0]).alias("pc1"), (pc[1] * signs[1]).alias("pc2"))


def pca_check(embeddings: DataFrame, components: DataFrame) -> DataFrame:
    """what, value: whether ``components`` of `pca_2d` are principal components of the scaled ``embeddings``.

    nodes; sum and cross: the greatest mean, and the covariance, of the two; whole: the variance of all scaled dimensions; loadings: how
    far the covariance matrix times each loading is from the loading times its variance. All rounded to three decimals. The covariance comes from one
    pass that sums products by pairs of dimensions, never from pairs of rows.
    """
    parts = embeddings.select("node", F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("i", "x"))
    moments = parts.groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    z = durable(parts.join(moments, "i").select("node", "i", ((F.col("x") - F.col("mean")) / F.col("sd")).alias("z")))
    wide = z.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "z"))), lambda p: p["z"]).alias("z"))
    crossed = wide.select(F.posexplode("z").alias("i", "a"), "z").select("i", "a", F.posexplode("z").alias("j", "b"))
    covariance = durable(crossed.groupBy("i", "j").agg(F.covar_samp("a", "b").alias("c")))
    # the covariance of a dimension with a component is the loading times the component's variance
    met = z.join(components, "node")
    own = met.groupBy("i").agg(*[F.covar_samp("z", f"pc{k}").alias(f"l{k}") for k in (1, 2)])
    spread = components.agg(*[F.var_samp(f"pc{k}").alias(f"v{k}") for k in (1, 2)], F.covar_samp("pc1", "pc2").alias("cross"), F.greatest(F.abs(F.avg("pc1")), F.abs(F.avg("pc2"))).alias("sum"), F.count(F.lit(1)).cast("double").alias("nodes"))
    again = covariance.join(own.select(F.col("i").alias("j"), "l1", "l2"), "j").groupBy("i").agg(*[F.sum(F.col("c") * F.col(f"l{k}")).alias(f"m{k}") for k in (1, 2)])
    far = again.join(own, "i").crossJoin(spread).agg(F.max(F.greatest(*[F.abs(F.col(f"m{k}") / F.col(f"v{k}") - F.col(f"l{k}")) for k in (1, 2)])).alias("loadings"))
    whole = covariance.where("i = j").agg(F.sum("c").alias("whole"))
    one = spread.crossJoin(far).crossJoin(whole)
    rounded = F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.abs(F.round(n, 3)).alias("value")) for n in ("nodes", "sum", "cross", "whole", "loadings")])).alias("x")
    return one.select(rounded).select("x.*")
