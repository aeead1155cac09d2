"""L1 / L2: threshold calibration of model scores and conversion of scored
synthetic rows into training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .prompts import delete_zeros

# Fixed values of the calibration grid: 100 thresholds on [0, 5].
GRID_N, GRID_HI = 100, 5.0
# Fixed value: timestamp given to synthetic training rows.
SYNTHETIC_TS = "2022-10-01 00:00:00"


def _grid(spark: SparkSession) -> DataFrame:
    step = GRID_HI / (GRID_N - 1)
    return spark.range(GRID_N).select(
        F.col("id").cast("int").alias("k"),
        F.when(F.col("id") == GRID_N - 1, F.lit(GRID_HI)).otherwise(F.col("id") * F.lit(step)).alias("t"))


def one_row_join(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the columns of a 1-row table (a global aggregate) to every row:
    broadcast hash join on a constant key; the broadcast side has exactly one
    row by construction."""
    k = "_one_row_key"
    return df.withColumn(k, F.lit(1)).join(F.broadcast(one.withColumn(k, F.lit(1))), k).drop(k)


def calibrate(scores: DataFrame, train: DataFrame, score_col: str = "predicted_logit") -> DataFrame:
    """L1: (t, diff) of the first grid threshold minimising
    |train positive rate - share(score >= t)|; one row."""
    spark = scores.sparkSession
    step = GRID_HI / (GRID_N - 1)
    s = F.col(score_col)
    tk = lambda k: F.when(k >= GRID_N - 1, F.lit(GRID_HI)).otherwise(k.cast("double") * F.lit(step))
    b0 = F.least(F.floor(s / F.lit(step)), F.lit(GRID_N - 1)).cast("int")
    b1 = F.when(s < tk(b0), b0 - 1).otherwise(b0)
    b = F.when((b1 + 1 <= GRID_N - 1) & (s >= tk(b1 + 1)), b1 + 1).otherwise(b1)
    b = F.when(s < 0, F.lit(-1)).otherwise(b)
    # <= 101 rows from here on: bucket counts, grid, two scalars
    per_b = scores.select(b.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("_c"))
    stats = one_row_join(scores.agg(F.count(F.lit(1)).alias("_n")),
                         train.agg(F.avg(F.col("label").cast("double")).alias("p1")))
    g = _grid(spark).join(per_b, "k", "left").fillna(0, ["_c"])
    g = g.withColumn("n_ge", F.sum("_c").over(Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)))
    g = one_row_join(g, stats)
    g = g.withColumn("diff", F.abs(F.col("p1") - F.col("n_ge") / F.col("_n")))
    best = g.agg(F.min_by(F.struct("k", "t", "diff", "p1", (F.col("n_ge") / F.col("_n")).alias("share")),
                          F.struct("diff", "k")).alias("b"))
    return best.select("b.*")


def apply_threshold(scores: DataFrame, best: DataFrame, score_col: str = "predicted_logit") -> DataFrame:
    """label = score >= t (the 1-row threshold is broadcast: proven size 1)."""
    j = one_row_join(scores, best.select(F.col("t").alias("_t")))
    return j.withColumn("label", (F.col(score_col) >= F.col("_t")).cast("int")).drop("_t")


def titles_lookup(samples: DataFrame) -> DataFrame:
    """id -> title table (S11 analogue): first title per item."""
    return samples.groupBy("iid").agg(F.min("title").alias("title"))


def lookup_array_titles(df: DataFrame, lookup: DataFrame, key: str = "row_id",
                        arr: str = "his", out: str = "his_title") -> DataFrame:
    """J5 for arrays: element-wise id -> title, order kept; unknown ids -> ''.
    posexplode -> equi-join -> per-row ordered collect (<= len(arr) per row)."""
    e = df.select(key, F.posexplode(arr).alias("_pos", "_id"))
    e = e.join(lookup.select(F.col("iid").alias("_id"), F.col("title").alias("_tt")), "_id", "left")
    g = e.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_tt", F.lit(""))
                                                                .alias("_tt")))).alias("_l"))
    g = g.select(key, F.transform("_l", lambda s: s["_tt"]).alias(out))
    return df.join(g, key, "left")


def synthetic_training_rows(scored: DataFrame, train: DataFrame, lookup: DataFrame, users: DataFrame | None = None, out=None) -> DataFrame:
    """L2: calibrated label, zero-free history, titles, fixed ts, env 0. With
    ``users`` (_r, his) the rows of ``scored`` name their history by ``_r``: its titles are
    looked up once per user, not once per row, and attached last, in the form that ``out`` gives them."""
    best = calibrate(scored, train)
    key = "row_id" if users is None else "_r"
    x = apply_threshold(scored, best).select("row_id", "uid", "iid", "label", *([delete_zeros("his").alias("his")] if users is None else ["_r"]))
    x = x.join(lookup, "iid", "left").withColumn("title", F.coalesce("title", F.lit("")))
    h = x if users is None else users.select("_r", delete_zeros("his").alias("his"))
    h = lookup_array_titles(h, lookup, key=key)
    if users is not None:
        x = x.join(cut_lineage(out(h) if out else h), "_r").drop("_r")
    else:
        x = h
    return x.withColumn("ts", F.lit(SYNTHETIC_TS).cast("timestamp_ntz")).withColumn("env", F.lit(0))
