"""The corpus pipeline: quality rules, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.functions.durable import durable, mark, release
from kinweave.functions.shipping import ship
from kinweave.llm import packing, quality, simhash, substring, toxicity
from kinweave.llm.encoding import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within the fences of their language and source.

    Null and empty texts go; long ones are measured whole; repeated rows are judged alike; null languages and sources
    are groups of their own. An empty table stays empty, here and in all stages.
    """
    return quality.keep_good(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic by a model fitted to their labels.

    Null and empty texts stay; long ones are scored whole; repeated rows are scored alike. Without labels of both kinds all stay.
    """
    ship(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each near-duplicate group; of rows that repeat a doc_id, one. Empty texts are one group."""
    ship(spark)
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words or more that occur again; those without any word left stay, empty."""
    ship(spark)
    return substring.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens. An empty text is its end token; repeated rows are packed like others."""
    ship(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", drop_toxic),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", pack),
]
#: Fitted weights and token ids can't be expressed in SQL; tests run the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents, each written as Parquet and read again; then all tables before it are deleted."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
        release(since, last=False)
    return docs
