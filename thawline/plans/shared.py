"""Shared, materialised intermediates of the pipelines.

Several queries start from the same prepared samples. They are written once
per session and data directory as parquet tables in the shared checkpoint
folder (``spark.checkpoint.dir``) and read back: the table survives executor
loss, and every downstream plan starts from a small scan leaf instead of
re-analysing the whole upstream tree (self-joins copy subtrees, so nested
operators would otherwise grow the logical plan exponentially).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import cut_lineage
from . import prep

_MEMO: dict = {}


def stamp(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of the tables in ``folder``: other data, other key."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)))


def memo(spark: SparkSession, parts: tuple, build, store: bool = True) -> DataFrame:
    """The stored table of ``parts`` (what, folder, ...): built once per
    application and state of the folder. Without ``store`` the frame is kept as
    it is, a cheap view of tables that ``build`` has stored."""
    k = (spark.sparkContext.applicationId, stamp(spark, parts[1]), *parts)
    df = _MEMO.get(k)
    if df is None:
        df = cut_lineage(build()) if store else build()
        _MEMO[k] = df
    return df


def forget() -> None:
    """Drop the memo: the next query pays for its whole chain."""
    _MEMO.clear()


def default_options(name: str) -> prep.PrepOptions:
    """Events follow the movie-ratings plan (warm eval items under-sampled to
    10%); orders follow the book plan (no under-sampling)."""
    return prep.PrepOptions(warm_eval_sample=0.1 if name == "events" else None)


def samples(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """prepared samples with histories, materialised."""
    opts = default_options(name)
    return memo(spark, ("samples", sf_dir, name), lambda: prep.samples(spark, sf_dir, name, opts))


def splits(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """samples with ``part`` (train / valid / test), materialised."""
    opts = default_options(name)
    # the train rows are those of the stored samples: only the evaluation rows are stored anew
    return memo(spark, ("splits", sf_dir, name), lambda: prep.split_samples(samples(spark, sf_dir, name), opts), store=False)


def part(spark: SparkSession, sf_dir: str, name: str, which: str, num: int = 0) -> DataFrame:
    return prep.split_view(splits(spark, sf_dir, name), which, num)
