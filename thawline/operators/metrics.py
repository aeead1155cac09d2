"""E1-E8 evaluation metrics and W10-W12 metric-log operators.

Ranks come from pre-aggregated score counts and prefix sums over range partitions
(``ordering``), never from a single-task global window over rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .calibrate import one_row_join
from .ordering import running_before

EPS = 1e-15  # fixed value: probability clipping of the log loss


def _score_counts(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Per (keys, score): positives, negatives, negatives strictly below."""
    c = df.groupBy(*keys, score).agg(F.sum(F.col(label).cast("long")).alias("_p"),
                                     F.sum((1 - F.col(label)).cast("long")).alias("_n"))
    return running_before(c, keys, [score], "_n", "_nb")


def auc(df: DataFrame, keys: list[str] | None = None, score: str = "score", label: str = "label") -> DataFrame:
    """ROC AUC with ties counted 1/2 (Mann-Whitney), per ``keys``:
    sum over scores of pos_s * (neg_below_s + neg_s / 2) / (P * N).
    Null when a group has one class, or a row without a score (null or NaN)."""
    keys = keys or []
    c = _score_counts(df, keys, score, label)
    known = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    g = c.groupBy(*keys).agg(
        F.sum(F.col("_p") * (F.col("_nb") + F.col("_n") / 2.0)).alias("_num"),
        F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"), F.min(known).alias("_known"))
    return g.select(*keys, "n_pos", "n_neg",
                    F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0) & F.col("_known"),
                           F.col("_num") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def user_auc(df: DataFrame, score: str = "score", label: str = "label", user: str = "uid",
             extra_keys: list[str] | None = None) -> DataFrame:
    """E2 per-user table: users with one row or one class are skipped
    (status column says why)."""
    keys = [*(extra_keys or []), user]
    a = auc(df, keys, score, label)
    status = (F.when(F.col("n_pos") + F.col("n_neg") == 1, F.lit("one_row"))
              .when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), F.lit("one_class"))
              .otherwise(F.lit("ok")))
    return a.withColumn("status", status)


def user_auc_summary(per_user: DataFrame, extra_keys: list[str] | None = None) -> DataFrame:
    """Mean per-user AUC over computed users, plus skip counts."""
    keys = extra_keys or []
    return per_user.groupBy(*keys).agg(
        F.avg(F.when(F.col("status") == "ok", F.col("auc"))).alias("uauc"),
        F.sum((F.col("status") == "ok").cast("long")).alias("n_users"),
        F.sum((F.col("status") == "one_row").cast("long")).alias("n_one_row"),
        F.sum((F.col("status") == "one_class").cast("long")).alias("n_one_class"))


def clipped_log(p, y, eps: float = EPS):
    pc = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -(y * F.log(pc) + (1 - y) * F.log(1 - pc))


def logloss(df: DataFrame, keys: list[str] | None = None, prob: str = "score", label: str = "label",
            eps: float = EPS) -> DataFrame:
    """Mean binary log loss with probability clipping."""
    y = F.col(label).cast("double")
    return df.groupBy(*(keys or [])).agg(F.avg(clipped_log(F.col(prob), y, eps)).alias("logloss"))


def report(pred: DataFrame, split: str = "split", score: str = "score", label: str = "label") -> DataFrame:
    """Auc, uauc, logloss per split in one tagged pass (null on failure)."""
    a = auc(pred, [split], score, label).select(split, "auc")
    u = user_auc_summary(user_auc(pred, score, label, extra_keys=[split]), [split]).select(split, "uauc")
    ll = logloss(pred, [split], score, label)
    return a.join(u, split, "full").join(ll, split, "full")


def accuracy(df: DataFrame, score: str = "score", label: str = "label", batch: int | None = None,
             batch_key: str = "row_id") -> DataFrame:
    """E5: ``acc_reported`` is the literal computation (scores > 0.5 become 1,
    the rest stay fractional; share of score == label), averaged over batches
    when ``batch`` is given; ``acc`` is the plain accuracy."""
    s, y = F.col(score), F.col(label).cast("double")
    b = F.when(s > 0.5, F.lit(1.0)).otherwise(s)
    x = df.withColumn("_hit", (b == y).cast("double")).withColumn("_ok", ((s > 0.5).cast("double") == y).cast("double"))
    if batch:
        per_b = (x.withColumn("_b", F.floor((F.col(batch_key) - 1) / batch))
                  .groupBy("_b").agg(F.avg("_hit").alias("_h"), F.avg("_ok").alias("_o")))
        return per_b.agg(F.avg("_h").alias("acc_reported"), F.avg("_o").alias("acc"))
    return x.agg(F.avg("_hit").alias("acc_reported"), F.avg("_ok").alias("acc"))


def dataset_loss(df: DataFrame, logit: str = "logit", label: str = "label", batch: int = 8192) -> DataFrame:
    """Sum of per-row BCE over the data / number of batches."""
    from ..functions.exprs import bce_with_logits
    return df.agg((F.sum(bce_with_logits(logit, label)) / F.ceil(F.count(F.lit(1)) / F.lit(batch)))
                  .alias("loss"))


# ---------------------------------------------------------------- metric logs
def best_config(metrics: DataFrame, metric: str = "valid_auc", config: str = "config") -> DataFrame:
    """Arg-max of a metric over a grid (ties: smallest config)."""
    return metrics.agg(F.min_by(F.col(config), F.struct(-F.col(metric), F.col(config))).alias("best_config"),
                       F.max(metric).alias(f"best_{metric}"))


def early_stop(log: DataFrame, metric: str = "valid_auc", patience: int = 20, low: float = 0.55,
               extra: int = 15, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """Per run, the epoch at which the early stopper stops.

    Running best before each epoch; an epoch improves when its metric is
    strictly above that best; the counter = epochs since the last
    improvement. Stop at the first epoch whose counter reaches the patience,
    where a best <= ``low`` at that moment grants ``extra`` epochs once.
    Runs that never stop report their last epoch with stopped = false.
    """
    w = Window.partitionBy(run).orderBy(epoch)
    x = log.withColumn("_prev_best", F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("_impr", F.col("_prev_best").isNull() | (F.col(metric) > F.col("_prev_best")))
    x = x.withColumn("_best", F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # epochs count as rows of the log, so a gap in their numbers is no stale epoch
    x = x.withColumn("_at", F.row_number().over(w))
    x = x.withColumn("_last_at", F.max(F.when(F.col("_impr"), F.col("_at"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("_cnt", F.col("_at") - F.col("_last_at"))
    # first time the counter reaches the base patience; if the best is low
    # then, the stop moves to the first epoch whose counter reaches patience+extra
    first = x.where(F.col("_cnt") >= patience).groupBy(run).agg(
        F.min_by(F.struct(F.col(epoch).alias("e"), F.col("_best").alias("b")), F.col(epoch)).alias("f"))
    ext = x.where(F.col("_cnt") >= patience + extra).select(run, F.col(epoch).alias("_e2"))
    cand = first.join(ext, run, "left").where(
        (F.col("f.b") > low) | (F.col("_e2") > F.col("f.e")))
    stop = cand.groupBy(run).agg(
        F.min(F.when(F.col("f.b") > low, F.col("f.e")).otherwise(F.col("_e2"))).alias("stop_epoch"))
    last = log.groupBy(run).agg(F.max(epoch).alias("_last"), F.max(metric).alias("best_metric"))
    return last.join(stop, run, "left").select(
        run, F.coalesce("stop_epoch", "_last").alias("stop_epoch"),
        F.col("stop_epoch").isNotNull().alias("stopped"), "best_metric")


def rolling_stats(log: DataFrame, value: str = "value", key: str = "metric", step: str = "step",
                  window: int = 20) -> DataFrame:
    """Per metric, rolling median (lower middle), mean and max over the
    last ``window`` values, and the global running mean."""
    w = Window.partitionBy(key).orderBy(step)
    roll = w.rowsBetween(-(window - 1), 0)
    vals = F.sort_array(F.collect_list(value).over(roll))
    return log.select(
        key, step, value,
        F.element_at(vals, ((F.size(vals) - 1) / 2).cast("int") + 1).alias("median"),
        F.avg(value).over(roll).alias("avg"),
        F.max(value).over(roll).alias("max"),
        F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("global_avg"))
