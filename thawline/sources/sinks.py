"""Writers. Every writer targets a folder under a base path that the
caller passes (on a cluster: shared storage)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import ts_to_epoch_millis, ts_to_epoch_seconds


def scratch_dir(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    import uuid

    from ..session import ensure_checkpoint_dir
    return os.path.join(ensure_checkpoint_dir(spark).rstrip("/"), "out", f"{name}-{uuid.uuid4().hex}")


def write_splits(df: DataFrame, path: str) -> str:
    """Samples per split, one partition folder per split value."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Intermediates, scored rows (keyed by row_id), influence per iter."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def append_json(df: DataFrame, path: str) -> str:
    """Metric records appended as JSON lines."""
    df.write.mode("append").json(path)
    return path


def write_ratings_csv(inter: DataFrame, path: str) -> str:
    """Ratings in the raw CSV shape (epoch seconds)."""
    (inter.select(F.col("uid").alias("userId"), F.col("iid").alias("movieId"), "rating",
                  ts_to_epoch_seconds("ts").alias("timestamp"))
          .write.mode("overwrite").option("header", True).csv(path))
    return path


def write_reviews_jsonl(inter: DataFrame, path: str) -> str:
    """Reviews in the raw JSON-lines shape (string ids, epoch milliseconds)."""
    (inter.select("rating", F.concat(F.lit("B"), F.col("iid").cast("string")).alias("parent_asin"),
                  F.concat(F.lit("U"), F.col("uid").cast("string")).alias("user_id"),
                  ts_to_epoch_millis("ts").alias("timestamp"))
          .write.mode("overwrite").json(path))
    return path
