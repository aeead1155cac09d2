"""Dense ids, numbered by key order (reproducible, unlike
first-appearance order in a frame whose order is arbitrary)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import global_positions


def dense_id_map(df: DataFrame, key: str, out: str, start: int = 1) -> DataFrame:
    """(key, out) with out = start + rank of key among distinct keys."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return global_positions(keys, [key], out, start=start)


def reencode(df: DataFrame, key: str, start: int = 1) -> DataFrame:
    """Replace ``key`` by its dense id."""
    m = dense_id_map(df, key, "_dense", start)
    return df.join(m, on=key, how="left").drop(key).withColumnRenamed("_dense", key)


def title_ids(items: DataFrame, start: int = 0) -> DataFrame:
    """D3: items sharing a title share ``title_idx``."""
    m = dense_id_map(items, "title", "title_idx", start)
    return items.join(m, on="title", how="left")
