"""Adapters that put the driver's tables into the shape of interaction data.

Two shapes are offered (see FIXTURES.md):

* ``events``  - dense, long per-user histories (the movie-ratings shape);
* ``orders``  - sparse, many items (the book-reviews shape).

Each adapter yields ``interactions(uid, iid, rating, ts)`` and
``items(iid, title, publish_time)``; a :class:`Profile` carries the cut-off
dates and thresholds the preparation pipeline uses for that shape.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table


@dataclass(frozen=True)
class Profile:
    name: str
    base_date: str           # publish date of the adapter's items = base + f(iid)
    publish_step: int        # days per title id step
    publish_mod: int         # days modulus
    cold_cutoff: str         # cold rule cut-off for publish time and first interaction
    train_start: str         # warm train: [train_start, eval_start)
    eval_start: str          # evaluation rows: [eval_start, eval_end]
    eval_end: str | None
    publish_rule: str        # 'min' (every id of the title is new) or 'any'
    user_min: int            # K1 threshold
    item_min: int            # K2 threshold
    filter_order: str        # 'items_users' or 'users_items' (K3)


# Fixed values of the adapters (FIXTURES.md section 3): dates, steps, thresholds.
EVENTS = Profile("events", "2024-01-01", 7, 30, "2024-01-19", "2024-01-03",
                 "2024-01-19", None, "min", 3, 3, "items_users")
ORDERS = Profile("orders", "1995-01-01", 37, 2400, "2000-07-01", "1996-01-01",
                 "2000-08-01", None, "any", 5, 3, "users_items")

PROFILES = {"events": EVENTS, "orders": ORDERS}


def _publish_expr(iid: Column, p: Profile) -> Column:
    days = (((iid / 2).cast("bigint") * p.publish_step) % p.publish_mod).cast("int")
    return F.date_add(F.lit(dt.date.fromisoformat(p.base_date)), days)


def _rating_from(x: Column) -> Column:
    return (F.lit(1) + F.floor(x).cast("bigint") % 5).cast("double")


def inter_events(spark: SparkSession, data_dir: str) -> DataFrame:
    """events -> (uid, iid, rating, ts); rows before the item's publish date dropped."""
    ev = table(spark, data_dir, "events").select(
        F.col("user_id").alias("uid"),
        F.get_json_object("props", "$.k").cast("bigint").alias("iid"),
        _rating_from(F.col("value")).alias("rating"),
        F.col("ts"),
    )
    return ev.filter(F.col("ts") >= _publish_expr(F.col("iid"), EVENTS)).distinct()


def inter_orders(spark: SparkSession, data_dir: str) -> DataFrame:
    """lineitem x orders -> (uid, iid, rating, ts)."""
    li = table(spark, data_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    od = table(spark, data_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    out = j.select(
        F.col("o_custkey").alias("uid"),
        F.col("l_partkey").alias("iid"),
        _rating_from(F.col("l_quantity")).alias("rating"),
        F.col("o_orderdate").alias("ts"),
    )
    return out.filter(F.col("ts") >= _publish_expr(F.col("iid"), ORDERS)).distinct()


def items_for(inter: DataFrame, p: Profile) -> DataFrame:
    """Item metadata of the adapter: two ids share each title."""
    ids = inter.select("iid").distinct()
    return ids.select(
        "iid",
        F.concat(F.lit("title-"), (F.col("iid") / 2).cast("bigint").cast("string")).alias("title"),
        _publish_expr(F.col("iid"), p).alias("publish_time"),
    )


def interactions(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return {"events": inter_events, "orders": inter_orders}[name](spark, data_dir)


def adapter(spark: SparkSession, data_dir: str, name: str):
    """(interactions, items, profile) for one adapter."""
    inter = interactions(spark, data_dir, name)
    p = PROFILES[name]
    return inter, items_for(inter, p), p
