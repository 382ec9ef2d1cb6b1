"""Ontology text in OBO form, line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.functions.durable import durable

SPLIT = ["file", "block"]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line, key, value: every line, cut at its first colon. ``line`` numbers those of a split of a file in order.

    Lines end in LF, CR or CRLF, in any mixture. A value has no outer white space; without a colon the line is the key and the value empty.
    """
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value"
    )
    parts = F.split("value", ":", 2)
    value = F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"^\s+|\s+$", "")
    return text.select(*SPLIT, "line", F.get(parts, F.lit(0)).alias("key"), value.alias("value"))


def stanza_lines(spark: SparkSession, path: str) -> DataFrame:
    """id, key, value: the lines of every term.

    A term reaches from the line before its ``id:`` to two lines before the next one's; what stands before the first term of a file
    belongs to none. Terms of which a line says ``namespace: external`` are left out, with all their lines in the
    file. Files of any size are read in splits; what a split begins with takes its id from a table of one row a split.
    """
    lines = durable(numbered_lines(spark, path))
    own = F.when(F.col("key") == "id", F.col("value"))
    splits = lines.withColumn("own", own).groupBy(*SPLIT).agg(
        F.max(F.when(F.col("own").isNotNull(), F.struct("line", "own")))["own"].alias("last_id"), F.min(F.struct("line", "own"))["own"].alias("first_id")
    )
    by_file = Window.partitionBy("file").orderBy("block")
    carried = F.last("last_id", ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    carry = splits.select(*SPLIT, carried.alias("carried"), F.lead("first_id").over(by_file).alias("following"))
    inside = Window.partitionBy(*SPLIT).orderBy("line")
    filled = lines.withColumn("own", own).select(
        *SPLIT, "key", "value",
        F.last("own", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("latest"),
        F.lead("own").over(inside).alias("ahead"), F.lead("line").over(inside).isNull().alias("ends"),
    )
    known = filled.join(carry, SPLIT).withColumn("id", F.coalesce(F.when(F.col("ends"), F.col("following")).otherwise(F.col("ahead")), "latest", "carried"))
    known = known.where("id IS NOT NULL").select("file", "id", "key", "value")
    external = known.where("key = 'namespace' AND value = 'external'").select("file", "id").distinct()
    return known.join(external, ["file", "id"], "left_anti").select("id", "key", "value")


def parse_obo(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """names, alt_ids, namespace, term_subsets, term_obsolete, term_relations, synonyms and external_ref of OBO files."""
    return tables(durable(stanza_lines(spark, path)))


def tables(lines: DataFrame) -> dict[str, DataFrame]:
    of = lambda key: lines.where(F.col("key") == key)
    bare = F.trim(F.split("value", "!")[0])
    related = of("relationship").select("id", F.split(bare, " ").alias("x")).select(
        F.col("id").alias("from"), F.get("x", F.lit(1)).alias("to"), F.get("x", F.lit(0)).alias("relationship")
    )
    is_a = of("is_a").select(F.col("id").alias("from"), bare.alias("to"), F.lit("is_a").alias("relationship"))
    quoted = F.regexp_extract("value", '"(.*)"', 1)
    scope = F.regexp_extract("value", '.*"\\s*(\\S+)', 1)
    return {
        "names": of("name").select("id", F.col("value").alias("name")),
        "alt_ids": of("alt_id").select(F.col("id").alias("term"), F.col("value").alias("alt_id")),
        "namespace": of("namespace").groupBy(F.col("value").alias("name_space")).agg(F.collect_set("id").alias("ids")),
        "term_subsets": of("subset").groupBy("value").agg(F.collect_set("id").alias("subset")),
        "term_obsolete": of("is_obsolete").where("value = 'true'").select("id"),
        "term_relations": related.unionByName(is_a),
        "synonyms": of("synonym").select(F.col("id").alias("term"), quoted.alias("synonym"), scope.alias("type")).distinct(),
        "external_ref": of("xref").select(F.col("id").alias("term"), F.split("value", " ")[0].alias("external_ref")),
    }
