"""Synthetic candidate interactions for new items.

Sampling "n users per item without replacement" is expressed without a
cross join: warm users are numbered 0..U-1 in md5(seed:uid) order; item i
walks its own permutation of 0..p-1, slot j -> (a_i * (j + b_i)^3 + c_i) mod p,
with a_i, b_i, c_i drawn from md5 and p the smallest prime from U on that leaves 2
when divided by 3 (cubes are then a permutation), skips the numbers from U on
(p - U of them at most), and takes the users numbered by its first n, an equi-join
on the number. Two items share about n * n / U users, as independent
samples do. Shared-sample variants take the numbers 0..n-1 for every item.
Fewer than n warm users raise. Output size is items x n, which is the
feature; nothing else grows with a product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.exprs import hash_order_key, hash_unit
from ..session import may_broadcast
from .ordering import global_positions


def warm_templates(train: DataFrame, min_rows: int = 10) -> DataFrame:
    """Users with >= min_rows train rows; their latest train row (ties:
    smallest iid). One aggregate with map-side combine (max_by is partial)."""
    cols = [c for c in train.columns if c != "uid"]
    key = F.struct(F.col("ts"), -F.col("iid"))
    agg = train.groupBy("uid").agg(F.count(F.lit(1)).alias("_n"),
                                   F.max_by(F.struct(*cols), key).alias("_t"))
    return agg.where(F.col("_n") >= min_rows).select("uid", "_t.*")


def target_items(test: DataFrame) -> DataFrame:
    """Distinct (iid, title) of a test split (first title per item)."""
    return test.groupBy("iid").agg(F.min("title").alias("title"))


def _users_in(df: DataFrame, valid: DataFrame | None, mode: str | None) -> DataFrame:
    if mode is None:
        return df
    v = valid.select("uid").distinct()
    return df.join(v, "uid", "left_semi" if mode == "in" else "left_anti")


def cubing_prime(n: int) -> int:
    """The smallest prime >= n whose remainder by 3 is 2; products of two numbers below it fit 64 bits."""
    c = max(2, n)
    while c % 3 != 2 or any(c % d == 0 for d in range(2, int(c ** 0.5) + 1)):
        c += 1
    if c >= 1 << 31:
        raise ValueError("more warm users than the walk's arithmetic holds")
    return c


def ranked_users(train: DataFrame, seed: int = 2000, version: str = "v0", valid: DataFrame | None = None,
                 min_rows: int = 10) -> DataFrame:
    """The templates of the users that a version draws from, numbered ``_r`` from 0 in md5 order; stored."""
    mode = {"v0": None, "v1": "out", "v2": "in", "v3": "out", "v4": "in"}[version]
    users = _users_in(warm_templates(train, min_rows), valid, mode)
    return global_positions(users.withColumn("_h", hash_order_key(seed, F.lit(version), "uid")),
                            ["_h", "uid"], "_r", start=0).drop("_h")


def _near(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A counted table for an equi-join with exploded rows. The engine takes the
    size of such rows from before their explode, so it must not pick the side itself."""
    return F.broadcast(df) if may_broadcast(df.sparkSession, rows, row_bytes) else df.hint("merge")


def sampled_rows(users: DataFrame, test: DataFrame, n: int = 80, seed: int = 2000, version: str = "v0", derive=None) -> DataFrame:
    """The narrow rows (row_id, uid, iid, title, _r) of the drawn users; what a user's
    template holds stays with ``users`` and is found again by ``_r``. ``derive``, a
    function of (iid, title, _ipos, _r and the columns of ``users``), computes columns
    where the template is at hand; it must keep iid, _ipos, _r and uid."""
    u_count = users.count()
    if u_count < n:
        raise ValueError(f"cannot sample {n} of {u_count} warm users without replacement")
    items = global_positions(target_items(test), ["iid"], "_ipos", start=0)
    if version in ("v0", "v3", "v4"):
        p = cubing_prime(u_count)
        draw = lambda letter: F.floor(hash_unit(seed, F.lit(version), F.lit(letter), "iid") * F.lit(p)).cast("long") % p

        def number(j):
            y = (j + F.col("_b")) % p
            return (F.greatest(F.col("_a"), F.lit(1)) * ((y * y % p) * y % p) + F.col("_c")) % p
        drawn, drawn_from = [draw("a").alias("_a"), draw("b").alias("_b"), draw("c").alias("_c")], u_count
    else:
        # the same n users for every item
        p, number, drawn, drawn_from, users = u_count, lambda j: j, [], n, users.where(F.col("_r") < n)
    # the walk is arithmetic on one row per item; the items are few bytes and many rows
    # once exploded, so their tasks are counted here and not by their size
    steps = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1 + p - u_count).cast("long")), number)
    tasks = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = (items.repartition(tasks, "iid").select("iid", "title", "_ipos", *drawn)
             .select("iid", "title", "_ipos", F.explode(F.slice(F.filter(steps, lambda r: r < u_count), 1, n)).alias("_r")))
    held = users.drop("iid", "title") if derive else users.select("_r", "uid")
    rows = slots.join(_near(held, drawn_from, 1024 if derive else 16) if drawn else F.broadcast(held), "_r")
    rows = derive(rows) if derive else rows
    # row_id = dense rank of (iid, uid): every item has exactly n users, so it
    # is item position * n + the user's rank inside the item (a window over a
    # group of exactly n rows; no global sort)
    w = Window.partitionBy("iid").orderBy("uid")
    return rows.withColumn("row_id", F.col("_ipos") * n + F.row_number().over(w)).drop("_ipos")


def attach(rows: DataFrame, users: DataFrame, version: str = "v0", n: int = 80) -> DataFrame:
    """Narrow rows with the columns of their template (``users`` may bring some of them, or rendered ones)."""
    shared = version in ("v1", "v2")  # then n templates serve all items
    return rows.join(F.broadcast(users.where(F.col("_r") < n)) if shared else users, "_r").drop("_r")


def generate(train: DataFrame, test: DataFrame, n: int = 80, seed: int = 2000,
             version: str = "v0", valid: DataFrame | None = None, min_rows: int = 10) -> DataFrame:
    """Synthetic rows: every template column kept, iid/title overwritten.

    v0 fresh sample per item (all warm users); v1 one shared sample, users
    not in valid; v2 shared, users in valid; v3 fresh, not in valid;
    v4 fresh, in valid. Adds ``row_id`` = dense rank of (iid, uid).
    """
    users = ranked_users(train, seed, version, valid, min_rows)
    rows = sampled_rows(users, test, n, seed, version)
    return attach(rows, users.drop("iid", "title", "uid"), version, n)


def add_row_id(df: DataFrame) -> DataFrame:
    """Dense rank of (iid, uid) for an arbitrary candidate table."""
    return global_positions(df, ["iid", "uid"], "row_id", start=1)


def score_candidates(df: DataFrame, scorer=None, text_col: str = "prompt", seed: int = 7,
                     keep: tuple = ("row_id", "uid", "iid", "his")) -> DataFrame:
    """A logit per rendered text: the ``keep`` columns and predicted_logit.

    The default scorer is a native column: a number in [0, 1] drawn from md5
    of the whole text, so the rendering decides every score. ``scorer``, any
    callable from a list of texts to floats (a language model), runs on Arrow
    batches instead.
    """
    if scorer is None:
        return df.select(*keep, hash_unit(seed, text_col).alias("predicted_logit"))
    rows = df.select(*keep, text_col)

    def run(batches):
        for pdf in batches:
            out = pdf[[*keep]].copy()
            out["predicted_logit"] = [float(v) for v in scorer(pdf[text_col].tolist())]
            yield out

    schema = StructType([*rows.drop(text_col).schema.fields, StructField("predicted_logit", DoubleType())])
    return rows.mapInPandas(run, schema)
