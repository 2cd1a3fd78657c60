"""The folder that driver and executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: where a single-node run keeps what a cluster keeps in spark.checkpoint.dir
LOCAL_DIR = "/tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """This application's part of the folder that the session names in spark.checkpoint.dir.

    A local session may leave it unset; on a cluster no machine's own folder will do.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = LOCAL_DIR
    return os.path.join(root, "weftgraph", spark.sparkContext.applicationId)


def shared_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_root(spark), f"{name}-{uuid.uuid4().hex}")


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage is cut, lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete what this application has written; frames that read it must not be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
