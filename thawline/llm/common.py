"""Shared pieces of the document operators: inputs and stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thawline.session import ensure_checkpoint_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the session's checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, read again.

    Cuts lineage: a lost executor costs a read of the table, not the work
    before it.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
        if folder.getName().rsplit("-", 1)[-1].isalnum() and "/llm/" in f:
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def squeezed(text: Column) -> Column:
    """Every run of blanks (space, tab to carriage return) as one space.

    Single spaces are left alone by the pattern, so only odd runs cost a
    replacement.
    """
    return F.regexp_replace(text, r"[\t-\r][ \t-\r]*| [ \t-\r]+", " ")


#: Bytes of an Arrow batch between Spark and Python workers.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH_BYTES`` where it is larger.

    Rows here are whole texts; a task holds a batch several times over (both
    processes, strings, arrays), so its size bounds the memory of the task.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(key).removesuffix("b")
    if not size.isdigit() or int(size) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")
