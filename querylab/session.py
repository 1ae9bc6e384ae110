"""SparkSession construction and cluster-safe scratch locations."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every querylab job wants, whatever the cluster size.
_BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "querylab", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with querylab defaults.

    On a cluster, ``master`` stays None and the launcher decides; the shuffle
    partition count is left to AQE coalescing unless given.  Locally, pass
    ``master="local[8]"`` and a small ``shuffle_partitions``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
        b = b.config("spark.driver.memory", os.environ.get("QUERYLAB_DRIVER_MEMORY", "16g"))
    for k, v in _BASE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only when it is unset on a
    local master (tests) create a private scratch folder.  Off local masters
    an unset folder is an error: the executors could not read the driver's."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="querylab-ckpt-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)  # made here, for this process only
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables."""
    return ensure_checkpoint_dir(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder (never machine-local
    on a cluster, since the folder comes from ``spark.checkpoint.dir``)."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/querylab-{name}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: cuts the
    lineage, and the planner knows the size of what it reads."""
    path = f"{scratch_path(df.sparkSession, 'tables')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
