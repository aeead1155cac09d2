"""Rolling positive history per user.

For each row, in time order per user: ``his`` is the last ``max_len`` of
``[0] + iids of the user's earlier positive rows`` (``his_title`` likewise
with ``''``). The current row and negatives never enter.

Plan: c = number of positives strictly before the row. Positive number j
(0-based) is the positive row whose own c is j, so the history of a row
with counter c is the positives with c in [c-max_len, c-1] — a RANGE frame
on c, at most ``max_len`` entries, never a whole per-user list.

Skew: the counter and the frame are computed per (uid, range partition of
(uid, ts, ...)). The positives a range needs from earlier ranges ("carry", at
most max_len per range) are fetched by an equi-join on (uid, c); only the last
max_len positives of each user and range take part in it. A hot user is
spread over as many tasks as its share of the rows. Rows with a null ts come
last in their user's order.

Incremental form: ``history_state`` keeps one row per user (the number of positives,
the last max_len of them, the last row's place in the order). ``rolling_history`` of
newer rows with that ``state`` gives what one run over old and new rows gives for
them; the old rows are not read again. ``newest_state`` merges the states of two runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import RANGE, by_range, ordered, same_key, straddling

ORDER = ["ts", "iid", "rating"]  # total order per user after the distinct


def _place(order: list[str]):
    """A row's place in its user's order as one comparable value, nulls last."""
    return F.struct(*[f for c in order for f in (F.col(c).isNull().alias(f"{c}_null"), F.col(c).alias(c))])


def history_state(df: DataFrame, max_len: int = 15, order: list[str] | None = None) -> DataFrame:
    """(uid, n_pos, last, recent) after the rows of a ``rolling_history`` result:
    number of positives, place of the last row, the last ``max_len`` positives as
    (c, iid, title) by rising number c. One row per user, also for users without a positive."""
    order = order or ORDER
    hit = F.col("label") == 1
    users = df.groupBy("uid").agg(F.max(F.col("n_pos_before") + F.when(hit, 1).otherwise(0)).alias("n_pos"), F.max(_place(order)).alias("last"))
    # at most max_len rows of a user meet in the list
    recent = (df.where(hit).join(users.select("uid", "n_pos"), "uid").where(F.col("n_pos_before") >= F.col("n_pos") - max_len)
                .groupBy("uid").agg(F.sort_array(F.collect_list(F.struct(F.col("n_pos_before").cast("long").alias("c"), "iid", "title"))).alias("recent")))
    return users.join(recent, "uid", "left").withColumn("recent", F.coalesce("recent", F.array().cast(recent.schema["recent"].dataType)))


def newest_state(old: DataFrame, new: DataFrame, max_len: int = 15) -> DataFrame:
    """The state after both runs: ``new`` comes from rows that continued ``old``."""
    j = old.alias("o").join(new.alias("n"), "uid", "full")
    both = F.concat(F.coalesce("o.recent", F.filter("n.recent", lambda r: F.lit(False))),
                    F.coalesce("n.recent", F.filter("o.recent", lambda r: F.lit(False))))
    j = j.select("uid", F.coalesce("n.n_pos", "o.n_pos").alias("n_pos"), F.coalesce("n.last", "o.last").alias("last"), both.alias("both"))
    kept = F.when(F.size("both") > max_len, F.slice("both", F.size("both") - max_len + 1, F.lit(max_len))).otherwise(F.col("both"))
    return j.select("uid", "n_pos", "last", kept.alias("recent"))


def rolling_history(df: DataFrame, max_len: int = 15, order: list[str] | None = None,
                    with_titles: bool = True, state: DataFrame | None = None) -> DataFrame:
    """Add ``his`` (array<long>), ``his_title`` (array<string>) and ``n_pos_before``.

    ``df`` needs uid, iid, label, ts (+ rating / title). With ``state`` the rows
    continue the histories it holds; a row that does not come after its user's
    last stored one raises, its history would change rows already given out.
    """
    order = order or ORDER
    positive = F.struct(F.col("iid"), (F.col("title") if with_titles else F.lit(None).cast("string")).alias("_t"))
    x = by_range(df.withColumn("_v", (F.col("label") == 1).cast("long")), ["uid"], order)
    side = straddling(x, ["uid"])
    x = x.join(F.broadcast(side), same_key(["uid"]), "left").withColumn("_boff", F.coalesce("_boff", F.lit(0))).drop("_all")
    # the last positives before a range, of the users that lie in several: as few rows
    last = F.row_number().over(Window.partitionBy("_k0", "_kr").orderBy(*[c.desc() if isinstance(c, Column) else F.col(c).desc_nulls_first() for c in order]))
    pos = (x.where(F.col("_kr").isNotNull() & (F.col("label") == 1)).withColumn("_n", last).where(F.col("_n") <= max_len)
            .select(F.col("_k0").alias("_pk"), (F.col("_boff") + F.col("_bsum") - F.col("_n")).alias("_c"), positive.alias("_p")))
    need = (side.where(F.col("_boff") > 0)
                .select("_k0", "_kr", F.explode(F.sequence(F.greatest(F.col("_boff") - max_len, F.lit(0)), F.col("_boff") - 1)).alias("_need")))
    carry = need.join(pos, F.col("_k0").eqNullSafe(F.col("_pk")) & (F.col("_need") == F.col("_c")))
    carry = carry.groupBy("_k0", "_kr").agg(F.sort_array(F.collect_list(F.struct("_c", "_p"))).alias("_l"))
    carry = cut_lineage(carry.select("_k0", "_kr", F.transform("_l", lambda r: r["_p"]).alias("_carry")))
    x = x.drop("_k0", "_kr", "_bsum").join(F.broadcast(carry), same_key(["uid"]), "left").drop("_k0", "_kr")
    lists = ["_carry", "_own"]
    if state is not None:
        recent = F.transform("recent", lambda r: F.struct(r["iid"].alias("iid"), (r["title"] if with_titles else F.lit(None).cast("string")).alias("_t")))
        x = x.join(state.select("uid", "n_pos", "last", recent.alias("_recent")), "uid", "left")
        late = x.where(_place(order) <= F.col("last")).count()
        if late:
            raise ValueError(f"{late} rows do not come after the stored history of their user")
        x = x.withColumn("_boff", F.col("_boff") + F.coalesce("n_pos", F.lit(0))).drop("n_pos", "last")
        lists = ["_recent", *lists]

    # counter and frame of a row inside its range: one shuffle for both
    wl = Window.partitionBy("uid", RANGE)
    before = F.sum("_v").over(wl.orderBy(*ordered(order)).rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_c", F.col("_boff") + F.coalesce(before, F.lit(0)))
    own = F.collect_list(F.when(F.col("label") == 1, positive)).over(wl.orderBy("_c").rangeBetween(-max_len, -1))
    x = x.withColumn("_own", own)
    none = F.filter("_own", lambda r: F.lit(False))
    every = F.concat(*[F.coalesce(c, none) for c in lists])
    x = x.withColumn("_h", F.when(F.size(every) > max_len, F.slice(every, -max_len, max_len)).otherwise(every))
    pad = F.col("_c") <= max_len - 1
    his = F.transform("_h", lambda s: s["iid"])
    out = x.withColumn("his", F.when(pad, F.concat(F.array(F.lit(0).cast("long")), his)).otherwise(his))
    if with_titles:
        ht = F.transform("_h", lambda s: F.coalesce(s["_t"], F.lit("")))
        out = out.withColumn("his_title", F.when(pad, F.concat(F.array(F.lit("")), ht)).otherwise(ht))
    return out.withColumnRenamed("_c", "n_pos_before").drop(RANGE, "_v", "_h", "_boff", *lists)
