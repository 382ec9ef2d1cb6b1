"""Typed networks from interaction, annotation and hierarchy edges."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.graph import first_of
from kinweave.schema import check_edges
from kinweave.sources.catalog import NAMESPACES, Catalog

#: Sources in the order in which they win over others for the same edge.
PPI_SOURCES = ("string", "signor", "reactome", "intact", "combined", "pc")
PATHWAY_SOURCES = ("go", "reactome")


@dataclass(frozen=True)
class Filtered:
    """A network for a set of genes; all tables are lazy."""

    graph: DataFrame
    genes_to_pathways: DataFrame
    represented_genes: DataFrame
    represented_pathways: DataFrame
    missing_genes: DataFrame


@dataclass(frozen=True)
class EdgeBundle:
    """Three edge tables (from, to): interactions, gene to pathway, pathway hierarchy."""

    ppis: DataFrame
    gene_to_pathways: DataFrame
    pathway_hierarchy: DataFrame

    def __post_init__(self):
        for name in ("ppis", "gene_to_pathways", "pathway_hierarchy"):
            check_edges(getattr(self, name), name)

    def _parts(self) -> list[DataFrame]:
        return [self.ppis, self.gene_to_pathways, self.pathway_hierarchy]

    def all_nodes(self) -> DataFrame:
        """node: every distinct end."""
        ends = [p.select(F.explode(F.array("from", "to")).alias("node")) for p in self._parts()]
        return ends[0].union(ends[1]).union(ends[2]).where("node IS NOT NULL").distinct()

    @cached_property
    def n_edges(self) -> int:
        """Rows of the three tables together, repeats included."""
        return sum(p.count() for p in self._parts())

    @cached_property
    def n_nodes(self) -> int:
        return self.all_nodes().count()

    def size(self) -> DataFrame:
        """n_edges (rows of the three tables) and n_nodes (distinct ends) as one row of one plan."""
        parts = [self.ppis, self.gene_to_pathways, self.pathway_hierarchy]
        rows = None
        for df in parts:
            ends = df.select(F.explode(F.array(F.struct(F.col("from").alias("node"), F.lit(1).alias("row")), F.struct(F.col("to").alias("node"), F.lit(0).alias("row")))).alias("x"))
            rows = ends if rows is None else rows.union(ends)
        nodes = rows.groupBy("x.node").agg(F.sum("x.row").alias("edges"))
        return nodes.agg(F.coalesce(F.sum("edges"), F.lit(0)).alias("n_edges"), F.count("node").alias("n_nodes"))

    def network(self) -> DataFrame:
        """All edges with their type, once each."""
        return typed_network(*self._parts())

    def filtered(self, genes: DataFrame, warn: bool = True) -> Filtered:
        """The part for ``genes(gene)``: interactions with both ends in it, annotations of it, the whole hierarchy.

        genes_to_pathways keeps repeated rows. With ``warn``, genes without any edge are counted and named in a warning.
        """
        wanted = genes.select(F.col("gene")).distinct()
        inside = lambda df, end: df.join(wanted.withColumnRenamed("gene", end), end, "left_semi")
        ppis = inside(inside(self.ppis.select("from", "to"), "from"), "to")
        annotations = inside(self.gene_to_pathways.select("from", "to"), "from")
        hierarchy = self.pathway_hierarchy.select("from", "to")
        ends = ppis.select(F.explode(F.array("from", "to")).alias("gene"))
        represented = ends.union(annotations.select("from")).distinct()
        pathways = annotations.select(F.col("to").alias("pathway")).union(hierarchy.select(F.explode(F.array("from", "to")))).distinct()
        missing = wanted.join(represented, "gene", "left_anti")
        if warn and (n := missing.count()):
            few = [r.gene for r in missing.orderBy("gene").limit(10).collect()]
            warnings.warn(f"{n} genes have no edges, such as {few}", stacklevel=2)
        return Filtered(typed_network(ppis, annotations, hierarchy), annotations.select("from", "to"), represented, pathways, missing)


def typed_network(ppis: DataFrame, gene_to_pathways: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """from, to, type of the three edge tables, without repeated rows."""
    parts = [(ppis, "interaction"), (gene_to_pathways, "part_of"), (hierarchy, "hierarchy")]
    typed = [df.select("from", "to", F.lit(kind).alias("type")) for df, kind in parts]
    return typed[0].unionByName(typed[1]).unionByName(typed[2]).distinct()


def first_source_wins(edges: DataFrame, order: tuple[str, ...] = PPI_SOURCES) -> DataFrame:
    """Of edges with the same (from, to) that of the first source in ``order``; sources that are not in it come last, by name."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source")), F.lit(0))
    key = F.struct(F.when(rank == 0, len(order) + 1).otherwise(rank).alias("rank"), F.col("source").alias("name"))
    return first_of(edges.withColumn("priority", key), ["from", "to"], "priority").drop("priority")


@dataclass
class NetworkBuilder:
    """Collects sources, then builds an `EdgeBundle` from a catalog. Methods return the builder itself."""

    catalog: Catalog
    pathway_sources: list[str] = field(default_factory=list)
    pathway_namespaces: list[str] = field(default_factory=list)
    ppi_sources: list[str] = field(default_factory=list)
    ppi_params: dict = field(default_factory=dict)
    bundle: EdgeBundle | None = None

    def add_pathways(self, source: str = "go", go_namespace=NAMESPACES) -> NetworkBuilder:
        """Adds a pathway source; namespaces of several calls are united."""
        _choice(source, PATHWAY_SOURCES, "pathway source")
        if source not in self.pathway_sources:
            self.pathway_sources.append(source)
        if source == "go":
            for n in [go_namespace] if isinstance(go_namespace, str) else go_namespace:
                _choice(n, NAMESPACES, "namespace")
                if n not in self.pathway_namespaces:
                    self.pathway_namespaces.append(n)
        return self

    def add_ppi(self, source: str = "combined", string_threshold=None, intact_threshold=None, intact_physical_only: bool = False) -> NetworkBuilder:
        """Adds an interaction source; thresholds count for their own source only."""
        _choice(source, PPI_SOURCES, "interaction source")
        if source not in self.ppi_sources:
            self.ppi_sources.append(source)
        if source == "string":
            self.ppi_params["string_threshold"] = string_threshold
        if source == "intact":
            self.ppi_params |= {"intact_threshold": intact_threshold, "intact_physical_only": intact_physical_only}
        return self

    def reset_choices(self) -> NetworkBuilder:
        self.pathway_sources, self.pathway_namespaces, self.ppi_sources, self.ppi_params, self.bundle = [], [], [], {}, None
        return self

    def build(self) -> NetworkBuilder:
        if not self.pathway_sources or not self.ppi_sources:
            raise ValueError("at least one pathway source and one interaction source are needed")
        self.bundle = EdgeBundle(self._ppis(), self._pathways(), self._hierarchy())
        return self

    def create_for_genes(self, genes: DataFrame):
        """An `Analysis` of the network around ``genes(gene)``."""
        from kinweave.plans.analysis import Analysis

        if self.bundle is None:
            raise ValueError("build() comes first")
        found = self.bundle.filtered(genes)
        return Analysis(found.graph, found.genes_to_pathways, found.represented_genes, found.represented_pathways)

    def full_network(self) -> DataFrame | None:
        if self.bundle is None:
            warnings.warn("build() comes first", stacklevel=2)
            return None
        return self.bundle.network()

    def __repr__(self) -> str:
        return (
            f"NetworkBuilder(pathways: {self.pathway_sources or 'none'}, namespaces: {self.pathway_namespaces or 'none'}, "
            f"interactions: {self.ppi_sources or 'none'}, parameters: {self.ppi_params}, built: {'yes' if self.bundle else 'no'})"
        )

    def _terms(self) -> DataFrame:
        return self.catalog.gene_ontology_info().where(F.col("name_space").isin(*self.pathway_namespaces)).select("go_id").distinct()

    def _union(self, parts: list[tuple[str, DataFrame]], order: tuple[str, ...]) -> DataFrame:
        tagged = [df.withColumn("source", F.lit(name)) for name, df in parts]
        out = tagged[0]
        for x in tagged[1:]:
            out = out.unionByName(x)
        return first_source_wins(out, order)

    def _pathways(self) -> DataFrame:
        parts = []
        if "go" in self.pathway_sources:
            terms = self._terms().withColumnRenamed("go_id", "to")
            parts.append(("go", self.catalog.gene_to_go().join(terms, "to", "left_semi").select("from", "to")))
        if "reactome" in self.pathway_sources:
            parts.append(("reactome", self.catalog.gene_to_reactome().select("from", "to")))
        return self._union(parts, PATHWAY_SOURCES)

    def _ppis(self) -> DataFrame:
        p = self.ppi_params
        tables = {
            "string": lambda: self.catalog.interactions_string(p.get("string_threshold")),
            "signor": self.catalog.interactions_signor,
            "reactome": self.catalog.interactions_reactome,
            "intact": lambda: self.catalog.interactions_intact(p.get("intact_threshold"), p.get("intact_physical_only", False)),
            "combined": self.catalog.interactions_combined,
            "pc": self.catalog.interactions_pc,
        }
        return self._union([(s, tables[s]().select("from", "to")) for s in PPI_SOURCES if s in self.ppi_sources], PPI_SOURCES)

    def _hierarchy(self) -> DataFrame:
        parts = []
        if "go" in self.pathway_sources:
            dag, terms = self.catalog.gene_ontology_hierarchy(), self._terms()
            for end in ("from", "to"):
                dag = dag.join(terms.withColumnRenamed("go_id", end), end, "left_semi")
            parts.append(("go", dag.select("from", "to", F.col("relationship").alias("edge_type"))))
        if "reactome" in self.pathway_sources:
            own = self.catalog.reactome_hierarchy(["parent_of"])
            parts.append(("reactome", own.select("from", "to", F.col("relationship").alias("edge_type"))))
        return self._union(parts, PATHWAY_SOURCES)


def _choice(value: str, allowed: tuple[str, ...], what: str) -> None:
    if value not in allowed:
        raise ValueError(f"{what} {value!r} is none of {list(allowed)}")
