"""Session helpers.

Jobs never write to a machine-local folder on their own: scratch output goes
under the shared folder the cluster names in ``spark.checkpoint.dir``.  Only
when that setting is absent (local tests) is a fresh temporary folder
created and registered.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF_KEY = "spark.checkpoint.dir"


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "cvframe") -> SparkSession:
    """Local/test session with AQE on and the UI off."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", os.environ.get("CVFRAME_MIN_PARTITION", "256k"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CVFRAME_DRIVER_MEMORY", "16g"))
    )
    if master:
        b = b.master(master)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; creates and registers one only if unset."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d.rstrip("/")
    d = sc.getConf().get(_CONF_KEY, None) or spark.conf.get(_CONF_KEY, None)
    if not d:
        if not sc.master.startswith("local"):
            # a folder on the driver's disk is invisible to executors
            raise RuntimeError(f"set {_CONF_KEY} to a shared folder (e.g. on the cluster file system)")
        d = tempfile.mkdtemp(prefix="cvframe-ckpt-")
        spark.conf.set(_CONF_KEY, d)
    sc.setCheckpointDir(d)
    return (sc.getCheckpointDir() or d).rstrip("/")


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh, unique sub-folder of the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder.

    Cuts the lineage and keeps a copy that outlives any executor; readers of
    the result scan the files instead of repeating the work above."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
