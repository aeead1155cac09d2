"""Session helpers: one place for the settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "thawline",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local/test session: UTC, AQE on, UI off, Arrow on.

    On a cluster the caller normally gets the session from the launcher;
    these settings are then only defaults where nothing is set yet.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "16g",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    Reads ``spark.checkpoint.dir`` from the session. Only when it is unset
    (local tests) a private folder is created; on a cluster the setting must
    point at shared storage, so a machine-local default is never invented
    there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset conf raises
            configured = None
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="thawline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def may_broadcast(spark: SparkSession, rows: int, row_bytes: int) -> bool:
    """Whether a counted table stays below the session's own broadcast threshold."""
    return rows * row_bytes <= spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def cut_lineage(df, eager: bool = True):
    """Cut lineage with a table written to the shared checkpoint folder.

    Equivalent to a reliable ``checkpoint()`` (it survives executor loss;
    ``localCheckpoint`` is never used) but computes the plan once and
    stores it columnar: ``Dataset.checkpoint`` evaluates an uncached plan
    twice (count, then the checkpoint write).
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("error").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # a given schema saves the job that reads one


def release(df) -> None:
    """Delete the table behind a ``cut_lineage`` result that nothing reads any
    more (superseded states of a loop); other frames are left alone."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    if folder.getParent() is not None and folder.getParent().getName() == "tables":
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
