"""Splits and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import hash_order_key, hash_unit
from .ordering import global_positions, running_before


def half_split(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Per item in time order, the first floor(n/2) rows -> 'valid', the
    rest -> 'test' (a single row goes to test). Position and item count come
    from the range-partitioned counter, not a per-item window."""
    order = order or ["ts", "uid", "rating"]
    x = running_before(df, ["iid"], order, F.lit(1), "_pos", total="_n")
    part = F.when(F.col("_pos") < F.floor(F.col("_n") / 2), F.lit("valid")).otherwise(F.lit("test"))
    return x.withColumn("part", part).drop("_pos", "_n")


def sample_items(df: DataFrame, p: float, seed: int = 2024, key: str = "iid") -> DataFrame:
    """Keep the floor(p * #items) items first in md5(seed:key) order
    (same distribution as a seeded shuffle; reproducible in SQL)."""
    items = df.select(key).distinct()
    ranked = global_positions(items.withColumn("_h", hash_order_key(seed, key)), ["_h", key], "_r")
    n = ranked.count()
    keep = ranked.where(F.col("_r") <= int(n * p)).select(key)
    return df.join(keep, key, "left_semi")


def sample_rows(df: DataFrame, frac: float, seed: int, *key_cols: str) -> DataFrame:
    """Seeded row sampling by a hash threshold (expected fraction)."""
    return df.where(hash_unit(seed, *key_cols) < frac)


def sample_exact(df: DataFrame, n: int, seed: int, *key_cols: str) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), first in md5(seed:keys) order;
    rows with equal keys are told apart by their range position."""
    h = df.withColumn("_h", hash_order_key(seed, *key_cols))
    return global_positions(h, ["_h", *key_cols], "_r").where(F.col("_r") <= n).drop("_h", "_r")
