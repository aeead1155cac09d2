"""Cold / warm cohorts, env split and activity filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import hash_order_key
from ..sources.adapters import Profile

# env codes (fixed values): 0 warm train, 1 warm test, 2 fake cold, 3 cold test
ENV_TRAIN, ENV_WARM_TEST, ENV_FAKE_COLD, ENV_COLD_TEST = 0, 1, 2, 3


def _ts(s: str) -> Column:
    # time-zone independent literal (the driver tables carry timestamp_ntz)
    dt.date.fromisoformat(s[:10])
    return F.lit(s).cast("timestamp_ntz")


def join_items(inter: DataFrame, items: DataFrame) -> DataFrame:
    """Interactions left-joined to item metadata (unmatched keep null title_idx)."""
    return inter.join(items.select("iid", "title", "title_idx", "publish_time"), "iid", "left")


def cold_titles(data: DataFrame, p: Profile) -> DataFrame:
    """A1 + D5: titles that are new by publish time AND by first interaction.

    ``min`` rule: every id of the title is published on/after the cut-off;
    ``any`` rule: some id is. One aggregate with map-side combine; the
    intersection is its HAVING.
    """
    cut = _ts(p.cold_cutoff)
    pub = F.min("publish_time") if p.publish_rule == "min" else F.max("publish_time")
    return (data.where(F.col("title_idx").isNotNull())
            .groupBy("title_idx")
            .agg(pub.alias("_pub"), F.min("ts").alias("_first"))
            .where((F.col("_pub").cast("timestamp_ntz") >= cut) & (F.col("_first") >= cut))
            .select("title_idx"))


def assign_env(data: DataFrame, cold: DataFrame, p: Profile) -> DataFrame:
    """Env 0 = warm rows in [train_start, eval_start); 1 = warm rows in
    the evaluation range; 3 = cold-title rows in the evaluation range; other
    rows are dropped. Rows with a null title are warm (anti-join semantics)."""
    flagged = data.join(cold.withColumn("_cold", F.lit(True)), "title_idx", "left")
    is_cold = F.coalesce(F.col("_cold"), F.lit(False))
    in_train = (F.col("ts") >= _ts(p.train_start)) & (F.col("ts") < _ts(p.eval_start))
    in_eval = F.col("ts") >= _ts(p.eval_start)
    if p.eval_end:
        in_eval = in_eval & (F.col("ts") <= _ts(p.eval_end))
    env = (F.when(is_cold & in_eval, ENV_COLD_TEST)
            .when(~is_cold & in_train, ENV_TRAIN)
            .when(~is_cold & in_eval, ENV_WARM_TEST))
    return flagged.withColumn("env", env).where(F.col("env").isNotNull()).drop("_cold")


def assign_env_by_month(data: DataFrame, cold: DataFrame, start: str, end: str, months: int = 12) -> DataFrame:
    """The month-window split: rows of the closed range [start, end]; the last
    ``months`` calendar months that occur are the test window. Cold titles: 3 in
    the window, gone before it; the others: 1 in the window, 0 before it."""
    from .calibrate import one_row_join
    x = data.where((F.col("ts") >= _ts(start)) & (F.col("ts") <= _ts(end)))
    x = x.withColumn("_m", F.month("ts") + 12 * F.year("ts"))
    x = one_row_join(x, x.agg(F.max("_m").alias("_last")))
    x = x.join(cold.withColumn("_cold", F.lit(True)), "title_idx", "left")
    is_cold, in_test = F.coalesce(F.col("_cold"), F.lit(False)), F.col("_m") > F.col("_last") - months
    env = (F.when(is_cold & in_test, ENV_COLD_TEST).when(~is_cold & in_test, ENV_WARM_TEST).when(~is_cold, ENV_TRAIN))
    return x.withColumn("env", env).where(F.col("env").isNotNull()).drop("_cold", "_m", "_last")


def fake_cold_items(data: DataFrame, ratio: float, seed: int = 2024) -> DataFrame:
    """W4 + D6: warm items held out as "fake cold": items seen only in the
    evaluation range, united with a seeded ``floor(ratio * n)`` sample of all
    warm items (md5 order)."""
    from .ordering import global_positions
    warm = data.where(F.col("env").isin(ENV_TRAIN, ENV_WARM_TEST))
    per_item = warm.groupBy("iid").agg(F.max((F.col("env") == ENV_TRAIN).cast("int")).alias("_has_train"))
    only_eval = per_item.where(F.col("_has_train") == 0).select("iid")
    ranked = global_positions(per_item.select("iid", hash_order_key(seed, "iid").alias("_h")),
                              ["_h", "iid"], "_r")
    n = per_item.count()
    sampled = ranked.where(F.col("_r") <= int(n * ratio)).select("iid")
    return only_eval.unionByName(sampled).distinct()


def apply_fake_cold(data: DataFrame, fake: DataFrame) -> DataFrame:
    """Fake-cold items: their evaluation rows become env 2, their train rows go."""
    f = data.join(fake.withColumn("_fake", F.lit(True)), "iid", "left")
    is_fake = F.coalesce(F.col("_fake"), F.lit(False))
    out = f.where(~(is_fake & (F.col("env") == ENV_TRAIN)))
    out = out.withColumn("env", F.when(is_fake & (F.col("env") == ENV_WARM_TEST), ENV_FAKE_COLD)
                         .otherwise(F.col("env")))
    return out.drop("_fake")


def filter_users(data: DataFrame, k: int) -> DataFrame:
    """K1: keep users with at least k rows (all envs)."""
    keep = data.groupBy("uid").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).select("uid")
    return data.join(keep, "uid", "left_semi")


def filter_items(data: DataFrame, k: int) -> DataFrame:
    """K2: keep items with at least k rows, then drop items whose train count
    is 1..k-1; items with no train row stay. The second step only removes
    whole items, so both counts come from one aggregate."""
    cnt = data.groupBy("iid").agg(F.count(F.lit(1)).alias("_n"),
                                 F.sum((F.col("env") == ENV_TRAIN).cast("long")).alias("_nt"))
    keep = cnt.where((F.col("_n") >= k) & ~((F.col("_nt") >= 1) & (F.col("_nt") < k))).select("iid")
    return data.join(keep, "iid", "left_semi")


def activity_filter(data: DataFrame, user_min: int, item_min: int, order: str) -> DataFrame:
    """K3: one pass each, in the given order (not to a fixpoint)."""
    if order == "items_users":
        return filter_users(filter_items(data, item_min), user_min)
    if order == "users_items":
        return filter_items(filter_users(data, user_min), item_min)
    raise ValueError(order)
