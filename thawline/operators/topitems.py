"""M5: the best items of every user, exactly, without all pairs.

Items are numbered by falling norm of their vectors and cut into blocks; users are
dealt to blocks by hash. A round gives the users that are still open the next item
blocks: one matrix product per (user block, item block) inside a task, of which at
most k rows a user leave. By Cauchy and Schwarz no item from a block on scores more
than (norm of the user) x (largest norm of the block); a user whose k-th score is
above that is closed. Rounds take 1, 2, 4, ... item blocks, so a long tail of short
vectors costs few rounds, and only users that need it meet it.

Scores tie to the smaller item id. Users without a vector are left out; with
fewer than k items all of them are returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import dot
from ..session import cut_lineage, release
from .graph import item_node, user_node
from .ordering import global_positions

USER_ROWS, ITEM_ROWS = 4096, 8192
SLACK = 1.0 + 1e-9  # rounding of sums in the bound
FOUND = "uid long, iid long, score double"


def _block_best(k: int):
    def run(users: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"uid": np.zeros(0, dtype=np.int64), "iid": np.zeros(0, dtype=np.int64), "score": np.zeros(0)})
        if not len(users) or not len(items):
            return empty
        items = items.sort_values("iid")
        iid = items["iid"].to_numpy()
        scores = np.stack(users["vec"].to_numpy()) @ np.stack(items["vec"].to_numpy()).T
        n = min(k, len(iid))
        # ties go to the smaller id: items are in order of id and the sort is stable
        if n < len(iid):
            edge = np.partition(scores, len(iid) - n, axis=1)[:, len(iid) - n]
        else:
            edge = np.full(len(users), -np.inf)
        floor = users["kth"].fillna(-np.inf).to_numpy(dtype=np.float64)
        out = []
        for u, row, a in zip(users["uid"].to_numpy(), scores, np.maximum(edge, floor)):
            at = np.flatnonzero(row >= a)
            at = at[np.argsort(-row[at], kind="stable")][:n]
            out.append(pd.DataFrame({"uid": u, "iid": iid[at], "score": row[at]}))
        return pd.concat(out, ignore_index=True)
    return run


def top_items(users: DataFrame, items: DataFrame, z: DataFrame, k: int = 10, user_rows: int = USER_ROWS, item_rows: int = ITEM_ROWS,
              log: list | None = None) -> DataFrame:
    """(uid, rank, iid, score): the k best of ``items`` (iid) for each of ``users`` (uid) by the product of their vectors in ``z``.

    ``log`` receives one (round, open user blocks, item blocks, all user blocks) per round."""
    vectors = z.select("node", "vec", F.sqrt(dot("vec", "vec")).alias("norm"))
    i = items.select("iid").distinct().withColumn("node", item_node("iid")).join(vectors, "node")
    i = global_positions(i.select("iid", "vec", "norm", (-F.col("norm")).alias("_o")), ["_o", "iid"], "place", start=0)
    i = cut_lineage(i.select("iid", "vec", "norm", F.floor(F.col("place") / item_rows).cast("long").alias("ib")))
    u = cut_lineage(users.select("uid").distinct().withColumn("node", user_node("uid")).join(vectors, "node").select("uid", "vec", "norm"))
    blocks = max(1, -(-u.count() // user_rows))
    u = u.withColumn("ub", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    last = i.agg(F.max("ib").alias("b")).first()["b"]
    best, lo, width = None, 0, 1
    while last is not None and lo <= last:
        hi = min(lo + width, last + 1)
        bound = i.filter(F.col("ib") == lo).agg(F.max("norm").alias("b")).first()["b"]
        if best is None:
            asked = u.withColumn("kth", F.lit(None).cast("double"))
        else:
            kth = best.filter(F.col("rank") == k).select("uid", F.col("score").alias("kth"))
            asked = u.join(kth, "uid", "left").filter(F.expr("kth is null") | (F.col("kth") <= F.col("norm") * F.lit(bound * SLACK)))
        asked = cut_lineage(asked)
        open_blocks = [r["ub"] for r in asked.select("ub").distinct().collect()]  # a few numbers per block of users
        if log is not None:
            log.append((len(log), len(open_blocks), hi - lo, blocks))
        if not open_blocks:
            break
        left = asked.select("uid", "vec", "kth", "ub", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)).cast("array<bigint>")).alias("ib"))
        here = i.filter(F.col("ib").between(lo, hi - 1))
        right = here.join(asked.select("ub").distinct().withColumn("ib", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)).cast("array<bigint>"))), "ib").select("iid", "vec", *[F.col(c).alias(c) for c in ("ub", "ib")])
        found = left.groupBy("ub", "ib").cogroup(right.groupBy("ub", "ib")).applyInPandas(_block_best(k), FOUND)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "iid"))
        after = cut_lineage(found.withColumn("rank", rank).filter(F.col("rank") <= k))
        if best is not None:
            release(best)
        release(asked)
        best, lo, width = after, hi, width * 2
    if best is None:
        return u.sparkSession.createDataFrame([], "uid long, rank int, iid long, score double")
    return best.select("uid", "rank", "iid", "score")
