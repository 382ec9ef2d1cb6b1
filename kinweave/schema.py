"""Column checks for edge tables and typed graphs."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE_TYPES = ("hierarchy", "interaction", "part_of")


def missing_columns(df: DataFrame, needed: tuple[str, ...]) -> list[str]:
    return [c for c in needed if c not in df.columns]


def check_edges(df: DataFrame, what: str = "edge table") -> DataFrame:
    """``df`` itself if it has from and to; else ValueError. Other columns are allowed."""
    if missing := missing_columns(df, ("from", "to")):
        raise ValueError(f"{what} lacks the columns {missing}")
    return df


def check_graph(df: DataFrame, strict: bool | None = False) -> DataFrame:
    """``df`` itself if it has from, to and type; else ValueError.

    Types that do not occur give a warning, or an error if ``strict``; None skips that look at the data.
    """
    if missing := missing_columns(df, ("from", "to", "type")):
        raise ValueError(f"graph lacks the columns {missing}")
    if strict is not None:
        seen = {r[0] for r in df.where(F.col("type").isin(*EDGE_TYPES)).select("type").distinct().collect()}
        if absent := sorted(set(EDGE_TYPES) - seen):
            if strict:
                raise ValueError(f"graph has no edges of the types {absent}")
            warnings.warn(f"graph has no edges of the types {absent}", stacklevel=2)
    return df
