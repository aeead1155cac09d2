"""Raw-file readers with declared schemas (no inference).

Delimited files are read by their header: columns are found by name, in any
order, and cast to the declared types; columns that are not declared are never
parsed out of the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATINGS = T.StructType([T.StructField("userId", T.LongType()), T.StructField("movieId", T.LongType()),
                        T.StructField("rating", T.DoubleType()), T.StructField("timestamp", T.LongType())])
MOVIES = T.StructType([T.StructField("movieId", T.LongType()), T.StructField("title", T.StringType()),
                       T.StructField("genres", T.StringType())])
LINKS = T.StructType([T.StructField("movieId", T.LongType()), T.StructField("imdbId", T.LongType()),
                      T.StructField("tmdbId", T.LongType())])
BASICS = T.StructType([T.StructField(c, T.StringType()) for c in
                       ("tconst", "titleType", "startYear", "endYear", "runtimeMinutes", "genres")])
REVIEWS = T.StructType([T.StructField("rating", T.DoubleType()), T.StructField("parent_asin", T.StringType()),
                        T.StructField("user_id", T.StringType()), T.StructField("timestamp", T.LongType())])
# the eleven metadata columns that are kept
META = T.StructType([T.StructField("title", T.StringType()), T.StructField("subtitle", T.StringType()),
                     T.StructField("author", T.StringType()), T.StructField("average_rating", T.DoubleType()),
                     T.StructField("rating_number", T.LongType()), T.StructField("features", T.ArrayType(T.StringType())),
                     T.StructField("price", T.StringType()), T.StructField("store", T.StringType()),
                     T.StructField("categories", T.ArrayType(T.StringType())),
                     T.StructField("details", T.MapType(T.StringType(), T.StringType())), T.StructField("parent_asin", T.StringType())])


def _by_name(raw: DataFrame, schema: T.StructType) -> DataFrame:
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"the header lacks {missing}; it has {raw.columns}")
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def read_csv(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """CSV with header; quoted fields may hold separators and doubled quotes."""
    return _by_name(spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path), schema)


def read_tsv(spark: SparkSession, path, schema: T.StructType = BASICS) -> DataFrame:
    """TSV with '\\N' as null; quotes are ordinary characters."""
    return _by_name(spark.read.option("header", True).option("sep", "\t").option("quote", "")
                    .option("nullValue", "\\N").csv(path), schema)


def read_jsonl(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """S3: JSON lines (splittable; no chunking code needed)."""
    return spark.read.schema(schema).json(path)


def epoch_seconds_to_ts(c) -> F.Column:
    """P4 (time-zone independent): epoch seconds -> timestamp_ntz."""
    return F.expr(f"timestampadd(SECOND, {c}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")


def epoch_millis_to_ts(c) -> F.Column:
    """Epoch milliseconds -> timestamp_ntz (explicit, never implicit)."""
    return F.expr(f"timestampadd(MILLISECOND, {c}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")


def ts_to_epoch_seconds(c) -> F.Column:
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def ts_to_epoch_millis(c) -> F.Column:
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def read_parquet_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several files as one table (bag union)."""
    return spark.read.parquet(*paths)


def read_train_files(spark: SparkSession, train_paths: list[str], valid_paths: list[str]) -> DataFrame:
    """S5 as the fits read it: every train file and the valid files of all
    rounds but the last (``valid_paths`` in the order of the rounds)."""
    return read_parquet_many(spark, [*train_paths, *valid_paths[:-1]])
