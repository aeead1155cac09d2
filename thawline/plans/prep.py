"""From raw interactions to time-split samples with histories.

interactions ⟕ items -> title ids -> cold rule -> env split -> activity
filters -> dense ids -> label + distinct -> rolling history -> splits.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import label_from_rating
from ..operators import cohorts, history, ids, splits
from ..session import cut_lineage
from ..sources import adapters


@dataclass(frozen=True)
class PrepOptions:
    reencode: bool = True           # D4 dense ids (start at 1: 0 is the history sentinel)
    id_start: int = 1
    warm_eval_sample: float | None = None   # W3 under-sampling of warm eval items
    fake_cold_ratio: float | None = None    # W4 fake-cold hold-out (env 2)
    date_range: tuple[str, str] | None = None  # closed range of a month-window split
    test_months: int = 12           # its test window: the last months of the range
    eval_end: str | None = None     # closed end of the evaluation range
    drop_incomplete: bool = False   # P6: rows with any null after the item join
    seed: int = 2024
    max_len: int = 15


def labelled(inter: DataFrame) -> DataFrame:
    """P1 + P7 + D1: (uid, iid, rating, ts, label), distinct rows."""
    return inter.select("uid", "iid", "rating", "ts",
                        label_from_rating("rating").alias("label")).distinct()


def history_slice(spark: SparkSession, data_dir: str, name: str = "events", max_len: int = 15) -> DataFrame:
    """Minimum slice: adapter -> label -> distinct -> W1 (no cohort rules)."""
    return history.rolling_history(labelled_titles(spark, data_dir, name), max_len=max_len)


def labelled_titles(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """Labelled rows with their item's title, stored."""
    inter = adapters.interactions(spark, data_dir, name)
    items = adapters.items_for(inter, adapters.PROFILES[name]).select("iid", "title")
    return cut_lineage(labelled(inter).join(items, "iid", "left"))


def history_by_batches(spark: SparkSession, data_dir: str, name: str, cuts: list[str], max_len: int = 15) -> DataFrame:
    """W1 as rows arrive: batches end before each of ``cuts`` (the last has no
    end); a batch reads its own rows and the stored state of the one before."""
    x = labelled_titles(spark, data_dir, name)
    state, out = None, None
    edges = [None, *cuts, None]
    for lo, hi in zip(edges, edges[1:]):
        here = F.lit(True)
        if lo:
            here = here & (F.col("ts") >= F.lit(lo).cast("timestamp_ntz"))
        if hi:
            here = here & (F.col("ts") < F.lit(hi).cast("timestamp_ntz"))
        # a null ts is last in the order: it belongs to the last batch
        here = F.coalesce(here, F.lit(hi is None))
        got = cut_lineage(history.rolling_history(x.where(here), max_len=max_len, state=state))
        out = got if out is None else out.unionByName(got)
        new = history.history_state(got, max_len)
        state = cut_lineage(new if state is None else history.newest_state(state, new, max_len))
    return out


def cohort_rows(spark: SparkSession, data_dir: str, name: str, opts: PrepOptions = PrepOptions()) -> DataFrame:
    """Rows with env after the cold rule and the activity filters (raw ids)."""
    p = adapters.PROFILES[name]
    if opts.eval_end:
        p = replace(p, eval_end=opts.eval_end)
    # materialisation points: the adapter output feeds items, title ids, the
    # cold rule and the env join; the env rows feed both activity filters
    inter = cut_lineage(adapters.interactions(spark, data_dir, name))
    # the cold rule only needs a title grouping key: the title itself serves
    # (D3's dense title ids are a separate operator, ``ids.title_ids``)
    items = adapters.items_for(inter, p).withColumn("title_idx", F.col("title"))
    data = cohorts.join_items(inter, items)
    if opts.drop_incomplete:
        data = data.na.drop("any")
    cold = cohorts.cold_titles(data, p)
    if opts.date_range:
        data = cut_lineage(cohorts.assign_env_by_month(data, cold, *opts.date_range, opts.test_months))
    else:
        data = cut_lineage(cohorts.assign_env(data, cold, p))
    if opts.fake_cold_ratio:
        data = cohorts.apply_fake_cold(data, cohorts.fake_cold_items(data, opts.fake_cold_ratio, opts.seed))
    return cohorts.activity_filter(data, p.user_min, p.item_min, p.filter_order)


def samples(spark: SparkSession, data_dir: str, name: str, opts: PrepOptions = PrepOptions()) -> DataFrame:
    """samples(uid, iid, label, ts, his, his_title, title, env, rating)."""
    data = cohort_rows(spark, data_dir, name, opts)
    # materialisation point: the id maps and the history all read these rows
    data = cut_lineage(data.select("uid", "iid", "rating", "ts", "title", "env"))
    if opts.reencode:
        data = ids.reencode(ids.reencode(data, "iid", opts.id_start), "uid", opts.id_start)
    data = data.withColumn("label", label_from_rating("rating")).distinct()
    return history.rolling_history(data, max_len=opts.max_len)


def split_samples(s: DataFrame, opts: PrepOptions = PrepOptions()) -> DataFrame:
    """Adds ``part`` in {train, valid, test}: env 0 -> train; warm eval
    (optionally item-sampled, W3) and cold eval -> W2 half split, stored; env 2 rows
    feed histories only and are not exported."""
    train = s.where(F.col("env") == cohorts.ENV_TRAIN).withColumn("part", F.lit("train"))
    warm = s.where(F.col("env") == cohorts.ENV_WARM_TEST)
    if opts.warm_eval_sample:
        warm = splits.sample_items(warm, opts.warm_eval_sample, opts.seed)
    mixed = warm.unionByName(s.where(F.col("env") == cohorts.ENV_COLD_TEST))
    return train.unionByName(cut_lineage(splits.half_split(mixed)))


def split_view(s: DataFrame, part: str, num: int) -> DataFrame:
    """Named outputs: train_1 = env 0; valid/test _0 mixed, _1 warm, _2 cold."""
    x = s.where(F.col("part") == part)
    if part == "train" or num == 0:
        return x
    return x.where(F.col("env") == {1: cohorts.ENV_WARM_TEST, 2: cohorts.ENV_COLD_TEST}[num])
