"""Session construction and checkpoint-directory handling."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_CHECKPOINT_ROOT: str | None = None


def get_spark(cpus: int | str = "*", app: str = "expstudy", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """A local session configured the way the tests and the bench expect.

    On a cluster, build the session with the cluster's own launcher instead;
    every operator only needs an active ``SparkSession``.
    """
    parts = shuffle_partitions or (os.cpu_count() if cpus == "*" else int(cpus))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting it on the context.

    The directory comes from ``spark.checkpoint.dir`` (a shared, fault-tolerant
    folder named by the cluster).  Only a local-mode session without that
    setting gets a private scratch folder, as in tests.
    """
    global _LOCAL_CHECKPOINT_ROOT
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; iterative operators need a shared "
                           "checkpoint folder on a cluster")
    if _LOCAL_CHECKPOINT_ROOT is None:
        _LOCAL_CHECKPOINT_ROOT = tempfile.mkdtemp(prefix="expstudy-ckpt-")
    sc.setCheckpointDir(_LOCAL_CHECKPOINT_ROOT)
    return sc.getCheckpointDir() or _LOCAL_CHECKPOINT_ROOT


def reliable_checkpoint(df):
    """Materialise ``df`` in the reliable checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
