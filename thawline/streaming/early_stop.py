"""W11 as a stateful stream over the appended metric log.

Per run the state holds what an early stopper holds: the best metric, the number of
records so far, the record of the last improvement, whether the extra patience was
granted and the epoch of the stop. A micro-batch reads only the new records of the
log and appends one status row for each run that it holds; a query that is started
again goes on from its checkpoint. ``stops`` keeps the newest status of each run: the
answer of ``operators.metrics.early_stop`` over the whole log.

A run's records arrive in the order of their epochs (inside a micro-batch any order
is fine). A record at or before the last epoch seen was delivered twice or late: it
changes nothing but ``n_late``. A null or NaN metric is an epoch without improvement,
a null run is a run, and records without an epoch are left to ``n_late`` as well. The
records of one run in one micro-batch are sorted in one task: at most the epochs of
``files_per_trigger`` files, two numbers each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .metric_log import LOG_SCHEMA

STATUS = "run int, last_epoch int, stop_epoch int, best_metric double, n_epochs long, n_late long"
STATE = "best double, seen long, improved_at long, granted boolean, stop_epoch int, last_epoch int, n_late long"


def _stopper(metric: str, patience: int, low: float, extra: int):
    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, seen, improved_at, granted, stop, last, late = state.get if state.exists else (None, 0, 0, False, None, None, 0)
        rows = pd.concat([c[["epoch", metric]] for c in chunks]).sort_values("epoch", kind="stable")
        for epoch, value in zip(rows["epoch"], rows[metric]):
            if pd.isna(epoch) or (last is not None and epoch <= last):
                late += 1
                continue
            last, seen = int(epoch), seen + 1
            value = None if pd.isna(value) else float(value)
            if best is None or (value is not None and value > best):
                best, improved_at = value, seen
            stale = seen - improved_at
            if stop is None and granted and stale >= patience + extra:
                stop = last
            elif stop is None and not granted and stale >= patience:
                if best is not None and best > low:
                    stop = last
                else:
                    granted = True
        state.update((best, seen, improved_at, granted, stop, last, late))
        yield pd.DataFrame({"run": pd.array([key[0]], dtype="Int32"), "last_epoch": pd.array([last], dtype="Int32"), "stop_epoch": pd.array([stop], dtype="Int32"),
                            "best_metric": pd.array([best], dtype="Float64"), "n_epochs": [seen], "n_late": [late]})
    return update


def statuses(stream: DataFrame, metric: str = "valid_auc", patience: int = 20, low: float = 0.55, extra: int = 15) -> DataFrame:
    """One status row for each run of each micro-batch, in append mode."""
    return stream.select("run", "epoch", metric).groupBy("run").applyInPandasWithState(
        _stopper(metric, patience, low, extra), STATUS, STATE, "append", GroupStateTimeout.NoTimeout)


def stops(rows: DataFrame) -> DataFrame:
    """The newest status of each run, with the columns of the batch form."""
    newest = rows.groupBy("run").agg(F.max_by(F.struct("last_epoch", "stop_epoch", "best_metric", "n_epochs", "n_late"), F.struct("n_epochs", "n_late")).alias("s"))
    return newest.select("run", F.coalesce("s.stop_epoch", "s.last_epoch").alias("stop_epoch"), F.col("s.stop_epoch").isNotNull().alias("stopped"),
                         F.col("s.best_metric").alias("best_metric"), F.col("s.n_epochs").alias("n_epochs"), F.col("s.n_late").alias("n_late"))


def watch(spark: SparkSession, log_dir: str, checkpoint: str, out_dir: str, patience: int = 20, low: float = 0.55,
          extra: int = 15, files_per_trigger: int = 1000) -> DataFrame:
    """Take in whatever is new in ``log_dir`` and return ``stops`` so far. The status
    rows go to ``out_dir`` exactly once; call it again with the same folders to go on."""
    src = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(log_dir)
    q = (statuses(src, patience=patience, low=low, extra=extra).writeStream.outputMode("append").format("parquet")
         .option("path", out_dir).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return stops(spark.read.schema(STATUS).parquet(out_dir))
