"""Follow the appended metric log (S10) with Structured Streaming.

Training appends one JSON record per (run, epoch). A streaming query over
that folder keeps, per run, the best validation metric so far and the epoch
it was reached (the state an early stopper needs), updated incrementally as
files arrive. ``availableNow`` processes whatever is there and stops, so the
same code serves a live monitor and a batch catch-up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "run int, epoch int, valid_auc double"


def best_so_far(stream: DataFrame, metric: str = "valid_auc") -> DataFrame:
    """Per run: best metric, epoch of the best (earliest on ties), epochs seen."""
    return stream.groupBy("run").agg(
        F.max(metric).alias("best_metric"),
        F.min_by("epoch", F.struct(-F.col(metric), F.col("epoch"))).alias("best_epoch"),
        F.max("epoch").alias("last_epoch"),
        F.count(F.lit(1)).alias("n_epochs"))


def follow(spark: SparkSession, log_dir: str, checkpoint: str, out_dir: str, files_per_trigger: int = 1000) -> DataFrame:
    """Run the aggregation over everything currently in ``log_dir``; each
    micro-batch replaces the table in a new folder under ``out_dir`` from its
    executors (nothing gathers on the driver) and the last one is returned."""
    last = {}

    def write(batch: DataFrame, number: int) -> None:
        path = f"{out_dir.rstrip('/')}/batch={number}"
        batch.write.mode("overwrite").parquet(path)  # a repeated batch writes the same rows again
        last["path"] = path

    src = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(log_dir)
    q = (best_so_far(src).writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if "path" not in last:
        return best_so_far(spark.createDataFrame([], LOG_SCHEMA))
    return spark.read.parquet(last["path"])
