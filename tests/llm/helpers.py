"""Awkward documents that every operator has to handle."""

from pyspark.sql import types as T

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
# columns that clash with names used inside the operators
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("fp", T.StringType()),
                       T.StructField("key", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("shard", T.StringType()),
                       T.StructField("length", T.StringType()), T.StructField("body", T.StringType()), T.StructField("score", T.StringType())])


def frame(spark, texts, ids=None, sources=None):
    """Documents with extra columns; ids default to 0, 1, 2, ..."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, None, (sources[k] if sources else None), None, "x", "x", "x", "x", "x", "x", "x") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
