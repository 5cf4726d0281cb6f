"""Spark session helpers shared by tests, the bench and the plans."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def get_spark(app: str = "riskframe", cores: str | int = "*",
              shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench.

    On a cluster the session comes from the launcher; nothing here is
    needed there except :func:`ensure_checkpoint_dir`.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/S3/...) folder there; we only set our own
    when the setting is absent, which is the local/test case.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not configured:
        # local runs only: no shared folder was named, take a scratch one
        configured = tempfile.mkdtemp(prefix="riskframe-ckpt-",
                                      dir=os.environ.get("RISKFRAME_SCRATCH", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once beside the checkpoints and read back, for tables that several passes read.

    Parquet keeps the passes that need few columns small, which a checkpoint's
    whole rows do not.  A table with a column of the null type, which Parquet
    cannot hold, is checkpointed.
    """
    folder = ensure_checkpoint_dir(df.sparkSession)
    if any(isinstance(f.dataType, T.NullType) for f in df.schema.fields):
        return df.checkpoint()
    path = f"{folder}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
