"""Session helpers shared by tests, the bench and applications."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quotelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for.

    Nothing here is required for correct results: the operators run on any session.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.numRecentProgressUpdates", "100000")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the cluster's own setting.

    A scratch folder of this machine is only taken where everything runs in this process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="quotelake-ckpt-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write rows that several passes read to the shared folder, once, and read them back."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Let Arrow batches of this session end at `size` bytes, however long their rows are.

    A worker then holds one block of queries with its shard, not a task's share of them. Results are the same.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
