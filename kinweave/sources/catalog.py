"""The catalog: thirteen Parquet tables in one folder."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Table names and what their columns and entries are called.
TABLES = (
    "gene_main", "reactome_main", "gene_ontology_main", "reactome_genes", "gene_ontology_genes", "reactome_ontology",
    "gene_ontology_dag", "interactions_string", "interactions_signor", "interactions_reactome", "interactions_intact",
    "interactions_pc", "interactions_combined",
)
RELATIONSHIPS = ("child_of", "parent_of", "ancestor_of", "descendant_of")
NAMESPACES = ("biological_process", "molecular_function", "cellular_component")
HEAD = 5
#: Folder of the manifests.
LOG = "_manifests"


class Catalog:
    """Reads and writes the tables under ``root``. Getters return lazy tables; ``head_only`` gives any five rows.

    A write goes to a folder of its own, and a manifest that names the folder of every table is put in place last, so all tables change at
    once or not at all. A catalog object keeps to the manifest it has seen first until `refresh`. Tables that no manifest names are
    looked for at ``root/<name>``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._places: dict[str, str] | None = None

    def _files(self, *parts: str):
        """The file system of the catalog and a path in it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Numbers of the manifests there are."""
        files, folder = self._files(LOG)
        found = files.listStatus(folder) if files.exists(folder) else []
        return sorted(int(name.removesuffix(".json")) for x in found if (name := x.getPath().getName()).endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Folder of each table, in the last version or the given one."""
        if version is None:
            have = self.versions()
            if not have:
                return {}
            version = have[-1]
        files, path = self._files(LOG, f"{version:020d}.json")
        stream = files.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def table(self, name: str, head_only: bool = False) -> DataFrame:
        if name not in TABLES:
            raise ValueError(f"{name!r} is no table of the catalog: {list(TABLES)}")
        if self._places is None:
            self._places = self.manifest()
        df = self.spark.read.parquet(f"{self.root}/{self._places.get(name, name)}")
        return df.limit(HEAD) if head_only else df

    def write(self, tables: dict[str, DataFrame]) -> dict[str, int]:
        """Replaces the given tables, all at once, and returns their rows, as counted by the writes themselves.

        This object then reads the new version, others after `refresh`. If a table fails, the catalog stays as it was. Of two writers at a time the
        second to finish fails.
        """
        if bad := [name for name in tables if name not in TABLES]:
            raise ValueError(f"{bad} are no tables of the catalog")
        have, folder, counts = self.versions(), f"version-{uuid.uuid4().hex}", {}
        for name, df in tables.items():
            seen = Observation()
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.root}/{folder}/{name}")
            counts[name] = seen.get["n"]
        places = (self.manifest(have[-1]) if have else {}) | {name: f"{folder}/{name}" for name in tables}
        self._put(have[-1] + 1 if have else 1, places)
        self._places = places
        return counts

    def _put(self, version: int, places: dict[str, str]) -> None:
        """Writes a manifest beside and renames it, which fails if the version is there."""
        files, draft = self._files(LOG, f"draft-{uuid.uuid4().hex}")
        _, final = self._files(LOG, f"{version:020d}.json")
        out = files.create(draft, False)
        try:
            out.write(json.dumps(places).encode())
        finally:
            out.close()
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise RuntimeError(f"version {version} of the catalog was written meanwhile; refresh and write again")

    def refresh(self) -> None:
        """Takes the last version from now on and forgets cached file listings and data."""
        self._places = None
        self.spark.catalog.refreshByPath(self.root)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes all but the last ``keep`` manifests, and the folders that none of these names; returns the folders. Readers of older versions lose their tables."""
        have = self.versions()
        if not have:
            return []
        named = {place.split("/")[0] for v in have[-keep:] for place in self.manifest(v).values()}
        files, root = self._files()
        gone = [n for x in files.listStatus(root) if (n := x.getPath().getName()).startswith("version-") and n not in named]
        for v in have[:-keep]:
            files.delete(self._files(LOG, f"{v:020d}.json")[1], False)
        for name in gone:
            files.delete(self._files(name)[1], True)
        return gone

    def register(self, prefix: str = "") -> None:
        """Temporary views of the tables there are, for spark.sql."""
        if self._places is None:
            self._places = self.manifest()
        for name in self._places or TABLES:
            try:
                df = self.table(name)
            except Exception as e:
                if "PATH_NOT_FOUND" in str(e):
                    continue
                raise
            df.createOrReplaceTempView(prefix + name)

    def gene_info(self, head_only: bool = False) -> DataFrame:
        return self.table("gene_main", head_only)

    def reactome_info(self, head_only: bool = False) -> DataFrame:
        return self.table("reactome_main", head_only)

    def gene_ontology_info(self, head_only: bool = False) -> DataFrame:
        return self.table("gene_ontology_main", head_only)

    def gene_to_go(self, head_only: bool = False) -> DataFrame:
        return self.table("gene_ontology_genes", head_only)

    def gene_to_reactome(self, head_only: bool = False) -> DataFrame:
        return self.table("reactome_genes", head_only)

    def reactome_hierarchy(self, relationship=RELATIONSHIPS, head_only: bool = False) -> DataFrame:
        wanted = [relationship] if isinstance(relationship, str) else list(relationship)
        if not wanted or (bad := [r for r in wanted if r not in RELATIONSHIPS]):
            raise ValueError(f"relationships must be among {list(RELATIONSHIPS)}, not {bad if wanted else wanted}")
        return _head(self.table("reactome_ontology").where(F.col("relationship").isin(wanted)), head_only)

    def gene_ontology_hierarchy(self, head_only: bool = False) -> DataFrame:
        return self.table("gene_ontology_dag", head_only)

    def interactions_string(self, threshold: float | None = None, head_only: bool = False) -> DataFrame:
        return _head(scored(self.table("interactions_string"), "string_score", threshold), head_only)

    def interactions_signor(self, head_only: bool = False) -> DataFrame:
        return self.table("interactions_signor", head_only)

    def interactions_reactome(self, head_only: bool = False) -> DataFrame:
        return self.table("interactions_reactome", head_only)

    def interactions_intact(self, threshold: float | None = None, physical_interactions: bool = False, head_only: bool = False) -> DataFrame:
        df = scored(self.table("interactions_intact"), "intact_score", threshold)
        return _head(df.where("physical_association") if physical_interactions else df, head_only)

    def interactions_pc(self, head_only: bool = False) -> DataFrame:
        return self.table("interactions_pc", head_only)

    def interactions_combined(self, head_only: bool = False) -> DataFrame:
        return self.table("interactions_combined", head_only)


def scored(df: DataFrame, column: str, threshold: float | None) -> DataFrame:
    """Rows whose score reaches the threshold, given to six decimals; all without one."""
    if threshold is None:
        return df
    if not 0 <= threshold <= 1:
        raise ValueError(f"a threshold lies between 0 and 1; this is {threshold}")
    return df.where(F.col(column) >= round(threshold, 6))


def _head(df: DataFrame, head_only: bool) -> DataFrame:
    return df.limit(HEAD) if head_only else df
