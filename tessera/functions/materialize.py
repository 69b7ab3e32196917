"""Writing an intermediate result once, to storage all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


_local_folders: list[tempfile.TemporaryDirectory] = []


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for reliable checkpoints: the cluster's ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.TemporaryDirectory(prefix="tessera-", ignore_cleanup_errors=True)
        _local_folders.append(folder)  # removed when the process ends
        configured = folder.name
    context.setCheckpointDir(configured)
    return configured


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once and go on from the written rows.

    Used where a result is read by several later jobs, or where its partition numbers must stay
    the same between them. The written files survive the loss of executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
