"""Session helpers: a local session for tests/bench, and the checkpoint folder.

Jobs never choose a machine-local folder on a cluster: the checkpoint folder is
read from ``spark.checkpoint.dir`` (or the SparkContext's checkpoint dir). Only a
``local[...]`` master without that setting gets a fresh scratch folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "riskloom") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RISKLOOM_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = tuned(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# How wide projections are planned and compiled; rows are unaffected.
PLANNING = {
    # constraint inference is exponential on the wide parse/rule projections
    "spark.sql.constraintPropagation.enabled": "false",
    # HotSpot does not JIT methods above 8000 bytes of bytecode: past that, drop to
    # per-operator code instead of running one huge fused method interpreted
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tuned(spark: SparkSession) -> SparkSession:
    """``spark`` with the settings of PLANNING where its user has set none."""
    for key, value in PLANNING.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts; set a scratch one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/...) "
            "before running jobs that cut lineage on a cluster"
        )
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="riskloom-ckpt-", dir="/tmp"))
    return sc.getCheckpointDir()


def reliable_checkpoint(df):
    """Materialise ``df`` in the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df, label: str):
    """``df`` written as Parquet in the shared checkpoint folder and read back: cuts the
    lineage like :func:`reliable_checkpoint`, and later reads prune columns and filter."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
