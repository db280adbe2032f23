"""Session helpers: the shared folder for written tables and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_OWN: dict[str, str] = {}  # folders of local sessions that name none


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names for checkpoints and written tables, which all executors see.

    On a cluster the setting is required. Only a local session, where driver and executors are
    one process, may go without: it gets a temporary folder.
    """
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _OWN[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Written to Parquet below the shared folder and read again: later jobs go on from there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
