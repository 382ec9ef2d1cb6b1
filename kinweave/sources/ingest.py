"""The catalog tables from nested Parquet and delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kinweave.functions.dealing import dealt

#: List columns of the pathway file and the relation that each stands for.
RELATION_OF = {"parents": "child_of", "children": "parent_of", "descendants": "ancestor_of", "ancestors": "descendant_of"}
#: Substrings that an end of an interaction must and must not hold.
HUMAN, OTHER_SPECIES = "ENSG", "ENSGGOG"
COMBINED = ("intact", "pc", "reactome", "signor", "string")


def gene_main(targets: DataFrame) -> DataFrame:
    return targets.select(F.col("id").alias("ensembl_id"), F.col("approvedSymbol").alias("symbol"), "biotype").distinct()


def reactome_main(reactome: DataFrame) -> DataFrame:
    return reactome.select(F.col("id").alias("reactome_id"), F.col("label").alias("reactome_name")).distinct()


def unnested(df: DataFrame, id_column: str, lists: str, item: str) -> DataFrame:
    """from, to: one row per entry of a list of structs; null and empty lists give none."""
    return df.where(F.col(lists).isNotNull()).select(F.col(id_column).alias("from"), F.explode(lists).alias("x")).select("from", F.col(f"x.{item}").alias("to"))


def reactome_genes(targets: DataFrame) -> DataFrame:
    return unnested(targets, "id", "pathways", "pathwayId")


def gene_ontology_genes(targets: DataFrame) -> DataFrame:
    return unnested(targets, "id", "go", "id").distinct()


def unpivoted_relations(df: DataFrame, id_column: str = "id", names: dict = RELATION_OF) -> DataFrame:
    """from, to, relationship: the entries of several list columns, each column's name recoded."""
    long = df.unpivot(id_column, list(names), "variable", "value")
    recode = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return long.select(F.col(id_column).alias("from"), F.explode("value").alias("to"), recode[F.col("variable")].alias("relationship"))


def expanded(df: DataFrame, column: str = "interactionResources") -> DataFrame:
    """``column`` unnested to the bottom: structs become their fields and lists rows, at any depth.

    Lists that lie side by side go on together, the shorter ones with nulls; a row whose lists are all empty or null is left out, as often as
    there are levels of lists. A null struct has null fields. A field keeps its own name, or, if another column has that too, gets the names
    on its way with underscores between. Maps stay as they are.
    """
    rest, parts = [c for c in df.columns if c != column], [(column,)]
    df = df.select(*[F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(rest)], F.col(f"`{column}`").alias("n0"))
    kept, serial = [f"r{i}" for i in range(len(rest))], 1
    while True:
        names = [c for c in df.columns if c not in kept]
        kinds = [df.schema[c].dataType for c in names]
        lists = [c for c, k in zip(names, kinds, strict=True) if k.typeName() == "array"]
        structs = {c: k.names for c, k in zip(names, kinds, strict=True) if k.typeName() == "struct"}
        if structs:
            out, ways = [], []
            for c, way in zip(names, parts, strict=True):
                for field in structs.get(c, [None]):
                    out.append((F.col(c) if field is None else F.col(c).getField(field)).alias(f"n{serial}"))
                    ways.append(way if field is None else (*way, field))
                    serial += 1
            df, parts = df.select(*kept, *out), ways
        elif lists:
            # a zip with a null list is null
            whole = {c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)) for c in lists}
            df = df.withColumns(whole).withColumn("x", F.explode(F.arrays_zip(*lists)))
            df = df.select(*kept, *[F.col(f"x.{c}").alias(c) if c in lists else c for c in names])
        else:
            break
    last = [way[-1] for way in parts]
    clear = [n if (last + rest).count(n) == 1 else "_".join(way) for n, way in zip(last, parts, strict=True)]
    return df.toDF(*rest, *clear)


def human_edges(edges: DataFrame) -> DataFrame:
    """Edges of which both ends are human genes."""
    keep = F.lit(True)
    for end in ("from", "to"):
        keep &= F.col(end).contains(HUMAN) & ~F.col(end).contains(OTHER_SPECIES)
    return edges.where(keep)


def _of_source(interactions: DataFrame, source: str) -> DataFrame:
    rows = expanded(interactions).where((F.col("sourceDatabase") == source) & F.col("targetA").isNotNull() & F.col("targetB").isNotNull())
    return rows.withColumnsRenamed({"targetA": "from", "targetB": "to"})


def interactions_string(interactions: DataFrame, high: float = 0.85) -> DataFrame:
    rows = _of_source(interactions, "string").select("from", "to", F.col("interactionScore").alias("string_score"))
    return human_edges(rows.withColumn("string_high_quality", F.col("string_score") >= high)).distinct()


def typed_interactions(interactions: DataFrame, source: str) -> DataFrame:
    """from, to, interaction_type of signor or reactome."""
    return human_edges(_of_source(interactions, source).select("from", "to", F.col("interactionTypeShortName").alias("interaction_type"))).distinct()


def interactions_intact(interactions: DataFrame) -> DataFrame:
    """One row per pair and score; physical_association if any of its types holds those words."""
    rows = _of_source(interactions, "intact").groupBy("from", "to", F.col("interactionScore").alias("intact_score"))
    physical = F.coalesce(F.bool_or(F.col("interactionTypeShortName").contains("physical association")), F.lit(False))
    return human_edges(rows.agg(physical.alias("physical_association"))).distinct()


def read_delimited(spark: SparkSession, path: str, counts: Observation | None = None) -> DataFrame:
    """Tab-separated text with a header, compressed or not. Rows of more or fewer fields than the header are left out.

    ``counts`` gets ``good`` and ``bad``, the numbers of rows, from the first job that reads the result; the file is not read for it.
    """
    header = spark.read.csv(path, sep="\t", header=True).schema
    bad = "malformed"
    while bad in header.names:
        bad += "_"
    kind = StructType([*header.fields, StructField(bad, StringType())])
    reader = spark.read.option("columnPruning", False)  # else only the fields that are asked for are counted
    rows = reader.csv(path, kind, sep="\t", header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=bad)
    if counts is not None:
        rows = rows.observe(counts, F.count_if(F.col(bad).isNull()).alias("good"), F.count_if(F.col(bad).isNotNull()).alias("bad"))
    return rows.where(F.col(bad).isNull()).drop(bad)


def interactions_pc(raw: DataFrame, genes: DataFrame, rows: int = 0) -> DataFrame:
    """from, to, type with symbols turned to ids; rows of which an end is unknown go. Of several ids the smallest counts.

    ``rows``, about how many rows ``raw`` has, bounds the rows of a task.
    """
    return dealt(_translated(raw, genes), rows, "from", "to").distinct()


def _translated(raw: DataFrame, genes: DataFrame) -> DataFrame:
    ids = genes.where("symbol IS NOT NULL").groupBy("symbol").agg(F.min("ensembl_id").alias("id"))
    out = raw.select(F.col("PARTICIPANT_A").alias("a"), F.col("PARTICIPANT_B").alias("b"), F.col("INTERACTION_TYPE").alias("type"))
    out = out.join(ids.select(F.col("symbol").alias("a"), F.col("id").alias("from")), "a")
    return out.join(ids.select(F.col("symbol").alias("b"), F.col("id").alias("to")), "b").select("from", "to", "type")


def interactions_combined(sources: dict[str, DataFrame]) -> DataFrame:
    """from, to and a boolean for each source that has the edge. Of string only edges of high quality count."""
    parts = None
    for name, df in sources.items():
        rows = df.where("string_high_quality") if name == "string" else df
        rows = rows.select("from", "to", F.lit(name).alias("source"))
        parts = rows if parts is None else parts.unionByName(rows)
    return source_flags(parts, COMBINED)


def combined_at_once(interactions: DataFrame, pathway_commons: DataFrame, genes: DataFrame, high: float = 0.85, rows: int = 0) -> DataFrame:
    """As `interactions_combined` of all five sources, from the raw files: one pass over the interactions, and repeated rows go in the one grouping by edge."""
    found = expanded(interactions).where("targetA IS NOT NULL AND targetB IS NOT NULL").where((F.col("sourceDatabase") != "string") | (F.col("interactionScore") >= high))
    own = human_edges(found.select(F.col("targetA").alias("from"), F.col("targetB").alias("to"), F.col("sourceDatabase").alias("source")))
    pc = _translated(pathway_commons, genes).select("from", "to", F.lit("pc").alias("source"))
    every = own.where(F.col("source").isin([x for x in COMBINED if x != "pc"])).unionByName(pc)
    return source_flags(dealt(every, 2 * rows, "from", "to"), COMBINED)


def source_flags(edges: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """from, to and a boolean for each of ``names`` that the edge has as a source."""
    return edges.groupBy("from", "to").agg(*[F.coalesce(F.bool_or(F.col("source") == n), F.lit(False)).alias(n) for n in names])


def build_tables(targets: DataFrame, reactome: DataFrame, interactions: DataFrame, pathway_commons: DataFrame, ontology: dict[str, DataFrame], rows: int = 0) -> dict[str, DataFrame]:
    """All thirteen tables, lazily, for `Catalog.write`. ``ontology`` is what `ontology.parse_obo` returns, ``rows`` about how many rows each interaction file has."""
    genes = gene_main(targets)
    string, intact = interactions_string(interactions), interactions_intact(interactions)
    signor, own = typed_interactions(interactions, "signor"), typed_interactions(interactions, "reactome")
    pc = interactions_pc(pathway_commons, genes, rows)
    spaces = ontology["namespace"].select(F.explode("ids").alias("id"), "name_space")
    return {
        "gene_main": genes,
        "reactome_main": reactome_main(reactome),
        "gene_ontology_main": ontology["names"].join(spaces, "id").select(F.col("id").alias("go_id"), F.col("name").alias("go_name"), "name_space"),
        "reactome_genes": reactome_genes(targets),
        "gene_ontology_genes": gene_ontology_genes(targets),
        "reactome_ontology": unpivoted_relations(reactome),
        "gene_ontology_dag": ontology["term_relations"],
        "interactions_string": string,
        "interactions_signor": signor,
        "interactions_reactome": own,
        "interactions_intact": intact,
        "interactions_pc": pc,
        "interactions_combined": combined_at_once(interactions, pathway_commons, genes, rows=rows),
    }
