"""Growing edge tables as streams: new edges once each, and running degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_SCHEMA = "`from` string, `to` string, type string, seen timestamp"


def edge_stream(spark: SparkSession, path: str, schema: str = EDGE_SCHEMA, max_files: int = 1000) -> DataFrame:
    """Edges from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def new_edges(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """The first of each (from, to, type) within ``late`` of its time ``seen``; state for older edges is dropped."""
    return stream.withWatermark("seen", late).dropDuplicatesWithinWatermark(["from", "to", "type"])


def running_degrees(stream: DataFrame) -> DataFrame:
    """type, node, degree over all edges so far; a self-loop counts twice. For output modes ``update`` and ``complete``."""
    ends = stream.select("type", F.explode(F.array("from", "to")).alias("node"))
    return ends.groupBy("type", "node").agg(F.count(F.lit(1)).alias("degree"))


def degrees_in_windows(stream: DataFrame, window: str, late: str = "1 day") -> DataFrame:
    """window, type, node, degree of edges by the time they were seen; a window is final once ``late`` has passed."""
    ends = stream.withWatermark("seen", late).select("seen", "type", F.explode(F.array("from", "to")).alias("node"))
    return ends.groupBy(F.window("seen", window), "type", "node").agg(F.count(F.lit(1)).alias("degree"))
